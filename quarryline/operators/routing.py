"""Routing, planning and grading rules as column expressions over a state table."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import folded, json_text, words
from quarryline.operators.models import json_field

MAX_STEPS = 6
CATEGORIES = ("factual", "comparative", "analytical", "summarization", "chitchat", "clarification", "procedural", "meta")
#: Words that ask for the conversation itself. Fixed values.
RECAP = "previous|discussed|conversation|recap"
RECAP_ROUTE = RECAP + "|summarize our"
#: Intent rules in the order they apply: the verb of a request before its topic. The words are fixed values.
INTENTS = (
    ("summarization", r"\b(give me points|list points|bullet points|key points|summari[sz]e|tldr|overview|executive summary|recap)\b"),
    ("comparative", r"\b(compare|vs|versus|difference between|which is better)\b"),
    ("procedural", r"\b(how do i|steps to|guide me|process for|walk me through)\b"),
    ("analytical", r"\b(why did|what caused|what if|how will)\b"),
    ("clarification", r"\b(tell me more|elaborate|what did you mean)\b"),
    ("meta", r"\b(what can you do|who are you|what do you know)\b"),
    ("factual", r"\b(what is|define|when did|who is|where is)\b"),
    ("chitchat", r"^\s*(hi|hello|hey|thanks|thank you|bye|goodbye|good morning)\b"),
)


def classify(text: Column) -> Column:
    """Category by the first rule that matches, factual if none does."""
    low, out = F.lower(text), None
    for name, pattern in INTENTS:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise("factual")


def valid_confidence(score: Column) -> Column:
    """Outside [0, 1], or missing: 0.7."""
    return F.when((score >= 0) & (score <= 1), score).otherwise(F.lit(0.7))


def route_after_classify(category: Column, complexity: Column, message: Column) -> Column:
    c = F.lower(F.coalesce(category, F.lit("factual")))
    return (
        F.when(c.isin("chitchat", "meta"), "simple_response")
        .when((c == "factual") & (F.coalesce(complexity, F.lit(1)) <= 2), "direct_synthesize")
        .when((c == "summarization") & F.lower(F.coalesce(message, F.lit(""))).rlike(RECAP_ROUTE), "synthesize")
        .otherwise("plan")
    )


def _forward(idx: Column, total: Column) -> Column:
    return F.when(idx + 1 < total, "next_sub_question").otherwise("grade")


def route_after_retrieve(decision: Column, round_: Column, max_rounds: Column, idx: Column, total: Column, steps: Column) -> Column:
    """The step cap first; a refinement while rounds are left; else on to the next question or to grading."""
    refine = (decision == "refine_query") & (round_ < max_rounds)
    return F.when(F.coalesce(steps, F.lit(0)) >= MAX_STEPS, "grade").when(F.coalesce(refine, F.lit(False)), "refine_query").otherwise(_forward(idx, total))


def route_after_next(idx: Column, total: Column) -> Column:
    return F.when(idx < total, "retrieve").otherwise("grade")


def plan(question: Column, category: Column) -> Column:
    """Sub-questions: the question itself if factual; else, as a stand-in for a model, its halves by words."""
    w = words(question)
    half = F.ceil(F.size(w) / 2).cast("int")
    two = F.array(F.array_join(F.slice(w, F.lit(1), half), " "), F.array_join(F.slice(w, half + 1, F.size(w)), " "))
    return F.when((category == "factual") | (F.size(w) < 2), F.array(question)).otherwise(two)


def coverage(sub_questions: Column, answers: Column, n_chunks: Column) -> Column:
    """Share of sub-questions that an answer holds or that hold an answer, letter case aside."""
    hit = F.filter(sub_questions, lambda q: F.exists(answers, lambda a: folded(q).contains(folded(a)) | folded(a).contains(folded(q))))
    n = F.size(sub_questions)
    return F.when(n > 0, F.least(F.size(hit) / n, F.lit(1.0))).otherwise(F.when(n_chunks > 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def completeness(n: Column, target: Column, category: Column, deep: Column | None = None) -> Column:
    """Level of a set of graded chunks; the deep check's level is the caller's, 'unknown' without one."""
    return (
        F.when(n == 0, "empty")
        .when(n >= F.coalesce(target, F.lit(5)), "sufficient")
        .when(category.isin("analytical", "procedural", "comparative"), deep if deep is not None else F.lit("unknown"))
        .when(n >= F.coalesce(target, F.lit(5)) * 0.5, "adequate")
        .otherwise("insufficient")
    )


#: Score of each level, and weights (relevance, coverage, completeness) by category.
LEVELS = {"sufficient": 0.9, "adequate": 0.7, "insufficient": 0.3, "empty": 0.0}
WEIGHTS = {"factual": (0.5, 0.2, 0.3), "summarization": (0.5, 0.2, 0.3), "comparative": (0.3, 0.4, 0.3), "analytical": (0.3, 0.4, 0.3), "procedural": (0.2, 0.3, 0.5)}
OTHER_WEIGHTS = (0.4, 0.3, 0.3)


def _by(value: Column, table: dict, other):
    out = F.when(F.lit(False), F.lit(other))
    for k, v in table.items():
        out = out.when(value == k, F.lit(v))
    return out.otherwise(F.lit(other))


def hundredths(value: Column) -> Column:
    """A value of 0 to 1 rounded to two digits as Python's ``round`` does it: by the exact binary value, and ties to even.

    A double is next to a midpoint (2k + 1) / 200 or is the one nearest to it; on which side of the midpoint that one
    lies, or whether it is the midpoint itself, is worked out here for each k."""
    middles = [(2 * k + 1) / 200 for k in range(101)]
    side = [Fraction(m) - Fraction(2 * k + 1, 200) for k, m in enumerate(middles)]
    up = [d > 0 or (d == 0 and k % 2 == 1) for k, d in enumerate(side)]
    k = F.least(F.greatest(F.floor(value * 100), F.lit(0)), F.lit(100)).cast("int")
    middle, rises = (F.element_at(F.lit(x), k + 1) for x in (middles, up))
    return (k + ((value > middle) | ((value == middle) & rises)).cast("int")) / 100


def overall_score(relevance: Column, covered: Column, level: Column, category: Column, digits: int = 2) -> Column:
    """The weighted score; two digits are rounded as Python rounds them, others half up."""
    weight = [_by(category, {k: w[i] for k, w in WEIGHTS.items()}, OTHER_WEIGHTS[i]) for i in range(3)]
    score = weight[0] * relevance + weight[1] * covered + weight[2] * _by(level, LEVELS, 0.5)
    return hundredths(score) if digits == 2 else F.round(score, digits)


def needs_refinement(score: Column, n_accepted: Column, level: Column) -> Column:
    return (score < 0.4) | (n_accepted < 2) | level.isin("empty", "insufficient")


#: The record that stands for an answer that can't be read, and its strategy. Fixed values.
FALLBACK = {
    "primary_category": "factual",
    "confidence_score": 0.6,
    "chunking_strategy": "medium",
    "max_retrieval_depth": 2,
    "target_chunks": 5,
    "complexity_level": 2,
    "requires_citation": True,
    "requires_source_attribution": True,
}
REQUIRED = ("primary_category", "confidence_score", "retrieval_strategy")


def validated(answer: Column) -> Column:
    """A router's JSON answer as a struct: the fallback record if a required field is missing, confidence bounded,
    confirmation asked for below 0.7, and the changes that procedural questions and chitchat bring.

    An answer that is no JSON, or none, gives the bare fallback record: nothing was classified, so nothing is to confirm."""
    v = F.try_parse_json(json_text(answer))
    unread = v.isNull()

    def field(path: str, kind: str) -> Column:
        return F.try_variant_get(v, f"$.{path}", kind)

    whole = F.coalesce(field("primary_category", "string").isNotNull() & field("confidence_score", "double").isNotNull() & field("retrieval_strategy", "variant").isNotNull(), F.lit(False))

    def kept(name: str, path: str, kind: str) -> Column:
        return F.when(whole, F.coalesce(field(path, kind), F.lit(FALLBACK[name]).cast(kind))).otherwise(F.lit(FALLBACK[name]).cast(kind))

    category = kept("primary_category", "primary_category", "string")
    confidence = valid_confidence(kept("confidence_score", "confidence_score", "double"))
    procedural, chat = category == "procedural", category == "chitchat"
    return F.struct(
        category.alias("category"),
        confidence.alias("confidence"),
        (~unread & (confidence < 0.7)).alias("requires_confirmation"),
        F.when(~unread & (confidence < 0.7), F.array(F.lit("factual"), F.lit("analytical"))).otherwise(F.array().cast("array<string>")).alias("fallback_categories"),
        F.when(procedural, "large").otherwise(kept("chunking_strategy", "retrieval_strategy.chunking_strategy", "string")).alias("chunking_strategy"),
        F.when(procedural, 3).otherwise(kept("max_retrieval_depth", "retrieval_strategy.max_retrieval_depth", "int")).alias("max_retrieval_depth"),
        F.when(chat, 0).otherwise(kept("target_chunks", "retrieval_strategy.target_chunks", "int")).alias("target_chunks"),
        kept("complexity_level", "complexity_level", "int").alias("complexity"),
        (~chat & kept("requires_citation", "requires_citation", "boolean")).alias("requires_citation"),
        (~chat & kept("requires_source_attribution", "requires_source_attribution", "boolean")).alias("requires_source_attribution"),
    )


def complexity(question: Column) -> Column:
    """Stand-in for the router's level: 2 up to twelve words, else 3."""
    return F.when(F.size(words(question)) <= 12, 2).otherwise(3)


def covered_with_fallback(found: Column, total: Column, assessed: Column | None = None) -> Column:
    """Coverage by counts; below one half, what a model assesses counts instead, if there is one."""
    counted = F.when(F.lit(assessed is not None) & (found < total * 0.5), F.coalesce(assessed if assessed is not None else found, F.lit(0))).otherwise(found)
    return F.when(total > 0, F.least(counted / total, F.lit(1.0))).otherwise(F.lit(1.0))


def texts_of(answer: Column) -> Column:
    """A model's JSON array of texts; empty if the answer can't be read as one."""
    read = F.try_variant_get(F.try_parse_json(json_text(answer)), "$", "array<string>")
    return F.filter(F.coalesce(read, F.array().cast("array<string>")), lambda t: F.trim(F.coalesce(t, F.lit(""))) != "")


def chunk_grade(answer: Column) -> Column:
    """A grader's JSON answer for a chunk as a struct; what can't be read is not relevant, with score 0."""
    relevant = json_field(answer, "relevant", "boolean", False)
    helps = F.try_variant_get(F.try_parse_json(json_text(answer)), "$.answers_sub_questions", "array<string>")
    return F.struct(
        relevant.alias("relevant"), json_field(answer, "score", "double", 0.0).alias("score"), json_field(answer, "reason", "string", "not graded").alias("reason"),
        F.coalesce(helps, F.array().cast("array<string>")).alias("answers"),
    )


def covered_by(answers: Column, subs: Column) -> Column:
    """Places of the sub-questions that graders' answers name, by number or by a text that holds the other."""
    low = folded
    return F.filter(
        F.transform(subs, lambda q, i: F.when(F.exists(answers, lambda a: (a.try_cast("int") == i) | (a.try_cast("int").isNull() & (low(q).contains(low(a)) | low(a).contains(low(q))))), i)),
        lambda i: i.isNotNull(),
    )


def assessed_coverage(answer: Column, subs: Column) -> Column:
    """How many sub-questions a model's answer calls covered; null if it can't be read."""
    found = F.try_variant_get(F.try_parse_json(json_text(answer)), "$.covered_indices", "array<int>")
    return F.size(F.array_distinct(F.filter(found, lambda i: (i >= 0) & (i < F.size(subs)))))


def deep_completeness(answer: Column) -> Column:
    """A model's assessment as (level, missing_critical_info, gaps, can_partially_answer, confidence); without an answer that
    can be read: unknown, nothing missing."""
    read = F.coalesce(F.try_parse_json(json_text(answer)).isNotNull(), F.lit(False))
    level = F.when(~read, "unknown").when(json_field(answer, "sufficient", "boolean", False), "sufficient").otherwise("insufficient")
    missing = read & json_field(answer, "missing_critical_info", "boolean", True)
    gaps = F.try_variant_get(F.try_parse_json(json_text(answer)), "$.gaps", "array<string>")
    return F.struct(
        level.alias("level"), missing.alias("missing_critical_info"), F.coalesce(gaps, F.array().cast("array<string>")).alias("gaps"),
        json_field(answer, "can_partially_answer", "boolean", False).alias("can_partially_answer"), F.when(read, json_field(answer, "confidence", "double", 0.5)).alias("confidence"),
    )


def acceptance(graded_relevant: Column, chunks: Column) -> Column:
    """Accepted chunks of a round: the relevant ones, or all of them if the grader accepted none."""
    return F.when(F.size(graded_relevant) > 0, graded_relevant).otherwise(chunks)


def last_decision(history: DataFrame, *, by: str = "question_id", step: str = "step") -> DataFrame:
    """(by, decision) of the last step of each history."""
    return history.groupBy(by).agg(F.max_by("decision", step).alias("decision"))


def split_graded(graded: DataFrame, relevant: Column, *, reason: Column, source: str = "source", section: str = "section", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(accepted rows as they are, rejected rows with source, section, reason and a preview of 100 characters); a null verdict rejects."""
    good = F.coalesce(relevant, F.lit(False))
    rest = graded.where(~good)
    kept = [c for c in rest.columns if c not in (source, section, text, "reason", "preview")]
    rejected = rest.select(*kept, F.col(source).alias("source"), F.col(section).alias("section"), reason.alias("reason"), F.substring(F.coalesce(F.col(text), F.lit("")), 1, 100).alias("preview"))
    return graded.where(good), rejected


def relevance(graded: DataFrame, relevant: Column, *, by: str) -> DataFrame:
    """(by, relevance_ratio, total): the share of each group's chunks that were accepted."""
    return graded.groupBy(by).agg(F.round(F.avg(F.coalesce(relevant, F.lit(False)).cast("int")), 6).alias("relevance_ratio"), F.count(F.lit(1)).alias("total"))


def accumulated(rounds: list[DataFrame], name: str = "round") -> DataFrame:
    """The rows of all rounds in turn, each with its round's number; earlier ones stay as they were."""
    out = rounds[0].withColumn(name, F.lit(0))
    for i, more in enumerate(rounds[1:], 1):
        out = out.unionByName(more.withColumn(name, F.lit(i)), allowMissingColumns=True)
    return out


def health(checks: DataFrame, ok: Column, *, by: str) -> DataFrame:
    """(by, healthy, status): a group is healthy if every one of its checks is; a check without a result is not."""
    every = F.every(F.coalesce(ok, F.lit(False)))
    return checks.groupBy(by).agg(every.alias("healthy"), F.when(every, "ok").otherwise("degraded").alias("status"))
