"""Ingest and answer as batched plans.

The loop runs over passes, at most MAX_STEPS of them, and each pass treats the live
sub-questions of all questions at once. Each role is played by a batch model (``Roles``: a list of
prompts to a list of answers) whose answers are validated and joined back, or, where none is
given, by a lexical stand-in over columns. Answers are kept by prompt, so a pass that is run
again asks nothing twice; a model that fails leaves its rows the role's safe default.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.ids import fingerprint, point_id
from quarryline.operators import context, routing
from quarryline.operators.models import AnswerTable, json_field
from quarryline.operators.chunking import fixed_windows
from quarryline.operators.retrieval import LexicalIndex, bm25_search, bm25_within, dense_search, dense_within, hybrid_search, overlap_score, query_variants, rerank, retrieval_decision, small_corpus_guard
from quarryline.sources import store


def ingest(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", size: int = 512, overlap: int = 64) -> DataFrame:
    """Chunks of all documents with their fingerprints and point ids."""
    chunks = fixed_windows(docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source_file")), size=size, overlap=overlap)
    return chunks.select(
        point_id(F.col("doc_id"), F.col("chunk_index")).alias("point_id"), "doc_id", "chunk_index", F.col("chunk_text").alias("text"), "source_file",
        fingerprint(F.encode("text", "UTF-8")).alias("fingerprint"),
    )


def relevant(query: Column, text: Column) -> Column:
    """Stand-in grader: a fifth of the query's tokens are there."""
    return overlap_score(query, text) >= 0.2


def extractive(question: Column, ctx: Column) -> Column:
    """Stand-in for the model that writes: the context's first 300 characters."""
    return F.concat(F.lit("From the documents: "), F.substring(ctx, 1, 300))


def longer_words(query: Column, round_: Column) -> Column:
    """Stand-in for the model that refines a query: its words of over three characters, one more each round."""
    return F.array_join(F.filter(F.split(query, " "), lambda w: F.length(w) > 2 + round_), " ")


def judged(n_relevant: Column, n_results: Column) -> Column:
    """Stand-in evaluator of a round: enough if two fifths of what was found is relevant, else a better query is needed."""
    return F.when(n_relevant >= 0.4 * n_results, "sufficient").otherwise("refine_query")


def first_six(question: Column) -> Column:
    """Stand-in for the model that rephrases: the first six words as the one alternative."""
    return F.array(F.array_join(F.slice(F.split(question, " "), 1, 6), " "))


Model = Callable[[list[str]], list[str]]


@dataclass
class Roles:
    """The batch models of each role; None leaves the role to its stand-in or default.

    ``rewrite`` resolves references to the history, ``route`` classifies, ``plan`` splits, ``expand`` gives two other
    phrasings, ``evaluate`` judges a round, ``refine`` gives a better query, ``grade`` judges a chunk, ``cover`` says which
    sub-questions are covered, ``complete`` whether a complex question can be answered, ``write`` answers."""

    rewrite: Model | None = None
    route: Model | None = None
    plan: Model | None = None
    expand: Model | None = None
    evaluate: Model | None = None
    refine: Model | None = None
    grade: Model | None = None
    cover: Model | None = None
    complete: Model | None = None
    write: Model | None = None


def retrieve(live: DataFrame, chunks: DataFrame, index: LexicalIndex, *, vectors: DataFrame | None = None, embed: Callable | None = None, k: int = 20, top: int = 5) -> DataFrame:
    """The ``top`` reranked chunks of each live query (query_id, text, sub, others, doc_filter), all variants and both kinds of search fused.

    ``others`` holds a query's other phrasings, which only a corpus of some size is searched with. A query
    with a ``doc_filter`` is searched in that document's chunks alone, by both kinds. A variant that the
    embedder fails on (a null vector) counts in neither list; if all fail, nothing is found. Without vectors
    and an embedder, the fusion is of the lexical lists.
    """
    spark = live.sparkSession
    key = F.to_json(F.struct(F.col("query_id").cast("string").alias("q"), F.col("variant").alias("v")))
    variants = small_corpus_guard(query_variants(live, F.col("others")), index.n_docs).withColumn("qv", key)
    variants = variants.join(live.select("query_id", "doc_filter"), "query_id")

    def parted(hits: DataFrame) -> DataFrame:
        back = F.from_json("query_id", "q string, v int")
        return hits.select(back["q"].alias("query_id"), back["v"].alias("variant"), "doc_id", "rank")

    dense_hits = None
    if vectors is not None and embed is not None:
        said = variants.where(F.trim(F.coalesce("query_text", F.lit(""))) != "")  # a refinement may leave no words
        variants = store.written(embed(said, text="query_text"), store.scratch_path(spark, "variants")).where("vector IS NOT NULL")
    free, bound = variants.where("doc_filter IS NULL"), variants.where("doc_filter IS NOT NULL")
    narrow = not bound.isEmpty()
    allowed = bound.select(F.col("qv").alias("query_id"), "doc_filter").join(chunks.select(F.col("chunk_id").alias("doc_id"), F.col("doc_id").cast("string").alias("doc_filter")), "doc_filter") if narrow else None

    def both(search: Callable, within: Callable, *first, **how) -> DataFrame:
        hits = search(*first, free, query="qv", k=k, **how).select("query_id", "doc_id", "rank")
        return hits.unionByName(within(*first, bound, allowed, query="qv", k=k, **how).select("query_id", "doc_id", "rank")) if narrow else hits

    sparse = parted(both(bm25_search, bm25_within, index, text="query_text"))
    dense_hits = sparse.where("false")
    if vectors is not None and embed is not None:
        held = vectors.select("chunk_id", "vector")
        dense_hits = parted(both(dense_search, dense_within, held, key="chunk_id", vector="vector"))
    hits = hybrid_search(dense_hits, sparse).where(F.col("rank") <= k)
    # Written, its size is known: a few hits are broadcast to the chunks, which then stay where they are.
    hits = store.written(hits, store.scratch_path(spark, "hits"))
    hits = hits.join(chunks.select(F.col("chunk_id").alias("doc_id"), F.col("text").alias("chunk"), "source", "section"), "doc_id").join(live, "query_id")
    return rerank(hits, query=F.col("sub"), text=F.col("chunk"), k=top)


def answer(
    questions: DataFrame, chunks: DataFrame, index: LexicalIndex, *, max_rounds: int = 2, models: Roles | None = None, answers: str | None = None, deadline: float | None = 30.0, attempts: int = 3,
    grade: Callable = relevant, write: Callable = extractive, evaluate: Callable = judged, refine: Callable = longer_words, alternatives: Callable = first_six,
    vectors: DataFrame | None = None, embed: Callable | None = None, target: int = 5, threshold: float = 0.85,
) -> DataFrame:
    """(question_id, category, route, steps, n_accepted, coverage, score, needs_refinement, sources, answer) of (question_id, question).

    ``questions`` may hold ``doc_filter`` (search that document alone) and ``history`` (earlier turns as text).
    ``index`` is over chunk ids (``chunk_id``); ``chunks`` holds chunk_id, text, source, section and, for filters, doc_id.
    The state of every question is a row; a pass retrieves for all that are at 'retrieve', decides, and
    routes each to a refined query, the next sub-question or grading, up to MAX_STEPS passes. The
    state of each pass is written, so that none is planned anew. Of every sub-question, the last one included, the chunks of its
    last round that found any are graded. Answers of ``models`` are kept in the folder ``answers``: give the same one to a
    later run and it asks only what is new.
    """
    spark, roles = questions.sparkSession, models or Roles()
    table = AnswerTable(spark, answers or store.scratch_path(spark, "answers"), deadline=deadline, attempts=attempts)
    no_texts = F.array().cast("array<string>")

    def kept(df: DataFrame, name: str) -> DataFrame:
        return store.written(df, store.scratch_path(spark, name))

    def ask(rows: DataFrame, role: str, prompt: Column, out: str) -> DataFrame:
        """``rows`` with the role's answer, null where it has no model, nothing is asked or it failed."""
        model = getattr(roles, role)
        return rows.withColumn(out, F.lit(None).cast("string")) if model is None else table.ask(rows, prompt, model, role, out)

    for name in ("doc_filter", "history"):
        if name not in questions.columns:
            questions = questions.withColumn(name, F.lit(None).cast("string"))
    state = ask(kept(questions.select("question_id", "question", F.col("doc_filter").cast("string").alias("doc_filter"), "history"), "questions"), "rewrite", context.rewrite_prompt(F.col("question"), F.col("history")), "rewritten")
    state = state.withColumn("question", F.coalesce(json_field(F.col("rewritten"), "rewritten_query", "string", None), F.col("question"))).drop("rewritten")
    state = ask(kept(state, "rewritten"), "route", context.routing_prompt(F.col("question"), F.col("history")), "routed")
    record = routing.validated(F.col("routed"))
    if roles.route is None:
        state = state.withColumns({"category": routing.classify(F.col("question")), "complexity": routing.complexity(F.col("question")), "target": F.lit(target)})
    else:
        state = state.withColumn("r", record).withColumns({"category": F.col("r.category"), "complexity": F.col("r.complexity"), "target": F.col("r.target_chunks")}).drop("r")
    state = state.withColumn("route", routing.route_after_classify(F.col("category"), F.col("complexity"), F.col("question"))).drop("routed")
    state = ask(kept(state, "routed"), "plan", F.when(F.col("route") == "plan", context.planning_prompt(F.col("question"), F.col("category"))), "planned")
    stand_in = routing.plan(F.col("question"), F.col("category")) if roles.plan is None else F.array("question")
    planned = routing.texts_of(F.col("planned"))
    planned = F.when(F.col("route") != "plan", F.array("question")).when(F.size(planned) > 0, planned).otherwise(stand_in)
    state = kept(state.withColumn("subs", F.when(F.col("route") != "simple_response", planned).otherwise(no_texts)).drop("planned"), "asked")
    # The first query is the question itself; it is reranked with its sub-question, as all others are.
    at = state.select("question_id", "doc_filter", "subs", F.lit(0).alias("idx"), F.lit(0).alias("round"), F.lit(0).alias("steps"), F.element_at(F.col("subs"), 1).alias("text"), F.lit("retrieve").alias("next"))
    at = at.where(F.size("subs") > 0)
    rounds, done, tried = [], [], []
    for step in range(routing.MAX_STEPS):
        live = at.withColumn("sub", F.element_at("subs", F.col("idx") + 1)).withColumn("query_id", F.to_json(F.struct(F.col("question_id").cast("string").alias("id"), "idx")))
        first = F.when(F.col("round") == 0, context.expansion_prompt(F.col("text")))
        live = ask(live, "expand", first, "said")
        others = routing.texts_of(F.col("said")) if roles.expand else F.when(F.col("round") == 0, alternatives(F.col("text"))).otherwise(no_texts)
        live = kept(live.withColumn("others", F.slice(others, 1, 2)).drop("said"), "live")
        wanted = live.select("query_id", "question_id", "idx", "round", "text", "sub", "others", "doc_filter")
        found = kept(retrieve(wanted, chunks, index, vectors=vectors, embed=embed).withColumn("step", F.lit(step)), "found")
        judged_rows = found.withColumn("good", grade(F.col("sub"), F.col("chunk")))
        texts = F.transform(F.array_sort(F.collect_list(F.struct("rerank", "chunk"))), lambda x: x["chunk"])
        per = judged_rows.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("int")).alias("n_good"), F.max("rrf_score").alias("best"), texts.alias("texts"))
        turn = live.join(per, "question_id", "left")
        unsure = (F.coalesce("n", F.lit(0)) > 0) & ~(F.col("best") > threshold)
        turn = ask(turn, "evaluate", F.when(unsure, context.evaluation_prompt(F.col("sub"), F.col("text"), F.col("texts"))), "judged")
        said = json_field(F.col("judged"), "decision", "string", "sufficient")
        verdict = F.when(said.isin("sufficient", "refine_query", "expand_search", "exhausted"), said).otherwise("sufficient")
        verdict = evaluate(F.coalesce("n_good", F.lit(0)), F.col("n")) if roles.evaluate is None else verdict
        turn = turn.withColumn("decision", retrieval_decision(F.col("best"), F.col("n"), verdict, threshold)).withColumns({"round": F.col("round") + 1, "steps": F.col("steps") + 1})
        turn = turn.withColumn("better", json_field(F.col("judged"), "refined_query", "string", None)).withColumn("reasoning", json_field(F.col("judged"), "reasoning", "string", "too little was found")).drop("judged", "texts")
        turn = kept(turn.withColumn("next", routing.route_after_retrieve(F.col("decision"), F.col("round"), F.lit(max_rounds), F.col("idx"), F.size("subs"), F.col("steps"))), "state")
        rounds.append(found)
        done.append(turn.where(F.col("next") == "grade").select("question_id", "steps"))
        tried.append(turn.select("question_id", "idx", F.lit(step).alias("step"), F.col("text").alias("query"), "reasoning"))
        on = turn.where(F.col("next") != "grade")
        if on.isEmpty():
            break
        again = F.col("next") == "refine_query"
        if roles.refine is not None:
            past = tried[0]
            for more in tried[1:]:
                past = past.unionByName(more)
            past = past.join(on.where(again & F.col("better").isNull()).select("question_id", "idx"), ["question_id", "idx"], "left_semi")
            on = on.join(context.attempts(past, by="question_id", step="step"), "question_id", "left")
            on = ask(on, "refine", F.when(again & F.col("better").isNull(), context.refinement_prompt(F.col("sub"), F.col("history"))), "told").drop("history")
            on = on.withColumn("better", F.coalesce("better", F.when(F.trim("told") != "", F.trim("told"))))
        text = F.when(again, F.coalesce("better", refine(F.col("sub"), F.col("round")))).otherwise(F.element_at("subs", F.col("idx") + 2))
        at = on.select("question_id", "doc_filter", "subs", F.when(again, F.col("idx")).otherwise(F.col("idx") + 1).alias("idx"), F.when(again, F.col("round")).otherwise(0).alias("round"), "steps", text.alias("text"), F.lit("retrieve").alias("next"))
    taken, ended = rounds[0], done[0]
    for more, end in zip(rounds[1:], done[1:], strict=True):
        taken, ended = taken.unionByName(more), ended.unionByName(end)
    last = taken.groupBy("question_id", "idx").agg(F.max("step").alias("step"))
    taken = taken.join(last, ["question_id", "idx", "step"]).join(state.select("question_id", "question", "subs"), "question_id")
    taken = ask(kept(taken, "taken"), "grade", context.grading_prompt(F.col("question"), F.col("subs"), F.col("source"), F.col("section"), F.col("chunk")), "graded")
    if roles.grade is None:
        taken = taken.withColumns({"good": grade(F.col("sub"), F.col("chunk")), "helps": F.array("sub")})
    else:
        taken = taken.withColumn("g", routing.chunk_grade(F.col("graded"))).withColumns({"good": F.col("g.relevant"), "helps": F.col("g.answers")}).drop("g")
    taken = kept(taken.drop("graded"), "graded")
    part = taken.where("good").withColumn("part", context.context_part(F.col("source"), F.col("section"), F.col("chunk"))).withColumn("place", F.col("step") * 100 + F.col("rerank"))
    in_order = F.array_sort(F.collect_list(F.when(F.col("good"), F.struct((F.col("step") * 100 + F.col("rerank")).alias("place"), F.col("chunk"), context.context_part(F.col("source"), F.col("section"), F.col("chunk")).alias("part")))))
    ratio = taken.groupBy("question_id").agg(
        F.avg(F.col("good").cast("int")).alias("ratio"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("good"), F.col("helps"))))).alias("answered"),
        F.sum(F.col("good").cast("int")).alias("n_accepted"), in_order.alias("best"),
    )
    out = state.join(ended, "question_id", "left").join(ratio, "question_id", "left")
    out = out.withColumns({"n_accepted": F.coalesce("n_accepted", F.lit(0)).cast("int"), "answered": F.coalesce("answered", no_texts), "texts": F.transform("best", lambda x: x["chunk"]), "parts": F.transform("best", lambda x: x["part"])}).drop("best")
    if roles.grade is None:
        out = out.withColumn("covered", routing.coverage(F.col("subs"), F.col("answered"), F.col("n_accepted")))
    else:
        n_subs, named = F.size("subs"), F.size(routing.covered_by(F.col("answered"), F.col("subs")))
        out = kept(out.withColumn("named", named), "named")
        few = (n_subs > 0) & (F.col("named") < n_subs * 0.5) & (F.col("n_accepted") > 0)
        out = ask(out, "cover", F.when(few, context.coverage_prompt(F.col("subs"), F.col("texts"))), "assessed")
        counted = routing.covered_with_fallback(F.col("named"), n_subs, F.when(few, F.coalesce(routing.assessed_coverage(F.col("assessed"), F.col("subs")), F.lit(0))) if roles.cover else None)
        out = out.withColumn("covered", F.when(n_subs > 0, counted).otherwise((F.col("n_accepted") > 0).cast("double")))
    deep = F.col("category").isin("analytical", "procedural", "comparative") & (F.col("n_accepted") > 0) & (F.col("n_accepted") < F.col("target"))
    out = ask(kept(out, "covered"), "complete", F.when(deep, context.completeness_prompt(F.col("question"), F.col("parts"))), "checked")
    level = routing.completeness(F.col("n_accepted"), F.col("target"), F.col("category"), routing.deep_completeness(F.col("checked"))["level"])
    score = routing.overall_score(F.coalesce("ratio", F.lit(0.0)), F.col("covered"), level, F.col("category"))
    out = out.withColumns({"score": score, "needs_refinement": routing.needs_refinement(score, F.col("n_accepted"), level)})
    for found in (context.build_context(part, by="question_id", order="place").drop("n_chunks"), context.sources_footer(part, by="question_id", order="place"), context.distinct_sources(part, "question_id")):
        out = out.join(found, "question_id", "left")
    simple = F.when(F.col("route") == "simple_response", F.lit("Hello. Ask me about the documents."))
    fixed = context.guard(F.col("n_accepted"), F.col("category"))
    out = ask(kept(out, "scored"), "write", F.when((F.col("route") == "simple_response") | fixed.isNull(), context.prompt(F.col("category"), F.col("question"), F.col("context"))), "told")
    said = context.with_citations(F.coalesce("told", write(F.col("question"), F.col("context"))), F.col("footer"))
    return out.select(
        "question_id", "category", "route", F.coalesce("steps", F.lit(0)).alias("steps"), "n_accepted", F.round("covered", 6).alias("coverage"), "score", "needs_refinement", "sources",
        F.when(F.col("route") == "simple_response", F.coalesce("told", simple)).otherwise(F.coalesce(fixed, said)).alias("answer"),
    )
