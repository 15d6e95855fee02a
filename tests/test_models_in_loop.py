"""The answer loop with scripted, failing and hanging models in its roles, filters by document, and answers that are kept."""

import json
import time

import pytest
from pyspark.sql import functions as F

from quarryline.operators import models, retrieval, routing
from quarryline.plans.answer import Roles, answer, retrieve

ASKED = "question_id string, question string, doc_filter string, history string"


@pytest.fixture(scope="module")
def store_of(spark):
    rows = [(i, f"d{i % 8}", f"topic{i % 6} explains part {i} of the matter with words{i}", f"s{i % 3}", f"sec{i % 2}") for i in range(48)]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id string, text string, source string, section string").cache()
    return chunks, retrieval.build_index(chunks, key="chunk_id")


def scripted(log, reply):
    """A model that answers by ``reply`` and writes down what it was asked."""

    def model(prompts):
        with open(log, "a") as f:
            f.writelines(json.dumps(p) + "\n" for p in prompts)
        return [reply(p) for p in prompts]

    return model


def lines(path):
    return [json.loads(x) for x in path.read_text().splitlines()] if path.exists() else []


def test_every_role_is_played_by_its_model(spark, store_of, tmp_path):
    chunks, index = store_of
    said = {
        "rewrite": lambda p: json.dumps({"rewritten_query": "why did topic3 explains change", "was_rewritten": True, "resolved_references": []}),
        "route": lambda p: json.dumps({"primary_category": "analytical" if "why" in p else "factual", "confidence_score": 0.9, "retrieval_strategy": {"target_chunks": 4}, "complexity_level": 2}),
        "plan": lambda p: '["topic3 explains", "nothing of the kind"]',
        "expand": lambda p: '["matter part", "words explains", "a third that is not taken"]',
        "evaluate": lambda p: json.dumps({"decision": "refine_query", "refined_query": "topic4 explains"} if "question: nothing" in p and "used: nothing" in p else {"decision": "sufficient"}),
        "grade": lambda p: json.dumps({"relevant": "topic3" in p.split("Chunk from")[1] or "topic4" in p.split("Chunk from")[1], "score": 0.8, "reason": "r", "answers_sub_questions": [0]}),
        "cover": lambda p: '{"covered_indices": [0, 1, 7]}',
        "complete": lambda p: '{"sufficient": true, "missing_critical_info": false}',
        "write": lambda p: f"written of {p.count('[Source: ')} parts",
    }
    roles = Roles(**{name: scripted(tmp_path / name, reply) for name, reply in said.items()})
    rows = [("1", "and it?", None, "1. User: about topic3"), ("me@site#0", "what is topic1", None, None)]
    df = spark.createDataFrame(rows, ASKED)
    run = lambda: {r.question_id: r for r in answer(df, chunks, index, models=roles, answers=f"file://{tmp_path}/answers").collect()}
    got = run()
    one, two = got["1"], got["me@site#0"]
    assert (one.category, one.route, two.category, two.route) == ("analytical", "plan", "factual", "direct_synthesize")
    assert one.steps == 3 and two.steps == 1  # the second sub-question was refined once
    assert one.n_accepted >= 4 and one.coverage == 0.5 and one.answer.startswith(f"written of {one.n_accepted} parts\n\n---\n**Sources Used:**")
    assert two.n_accepted == 0 and two.answer.startswith("I could not find")
    assert len(lines(tmp_path / "rewrite")) == 1 and all("third" not in p for p in lines(tmp_path / "evaluate"))
    assert any("used: topic4 explains" in p for p in lines(tmp_path / "evaluate"))
    before = {name: len(lines(tmp_path / name)) for name in said}
    again = run()
    assert {i: tuple(r) for i, r in again.items()} == {i: tuple(r) for i, r in got.items()}
    assert {name: len(lines(tmp_path / name)) for name in said} == before  # all of it was known


def test_failing_models_leave_safe_defaults(spark, store_of):
    chunks, index = store_of

    def broken(prompts):
        raise RuntimeError("down")

    names = ("rewrite", "route", "plan", "expand", "evaluate", "refine", "grade", "cover", "complete", "write")
    df = spark.createDataFrame([("1", "compare topic2 with topic3", None, "earlier")], ASKED)
    got = answer(df, chunks, index, models=Roles(**{n: broken for n in names}), attempts=1).collect()[0]
    assert got.category == "factual" and got.route == "direct_synthesize" and got.n_accepted == 0 and got.coverage == 0.0 and got.answer.startswith("I could not find")
    unread = Roles(**{n: (lambda prompts: ["?"] * len(prompts)) for n in names if n != "grade"})
    got = answer(df, chunks, index, models=unread).collect()[0]
    assert got.n_accepted > 0 and got.answer.startswith("?")


def test_a_filter_and_ids_with_marks_in_them(spark, store_of):
    chunks, index = store_of
    rows = [("plain", "topic1 explains the matter", None, None), ("me@site", "topic1 explains the matter", None, None), ('q"#@1', "topic1 explains the matter", "d7", None), ("none", "topic1 explains the matter", "d99", None)]
    vectors = models.embed_documents(chunks).select("chunk_id", "vector")
    for how in ({}, {"vectors": vectors, "embed": models.embed_queries}):
        got = {r.question_id: r for r in answer(spark.createDataFrame(rows, ASKED), chunks, index, **how).collect()}
        assert got["plain"].n_accepted == got["me@site"].n_accepted > 0 and got["plain"].answer == got["me@site"].answer
        assert got['q"#@1'].n_accepted > 0 and got["none"].n_accepted == 0
    live = spark.createDataFrame([("x@1", "topic1 explains", "topic1 explains", 0, "d7"), ("y", "topic1 explains", "topic1 explains", 0, None)], "query_id string, text string, sub string, round int, doc_filter string").withColumn("others", F.array(F.lit("part of the matter")))
    found = retrieve(live, chunks, index, vectors=vectors, embed=models.embed_queries).collect()
    assert {r.doc_id % 8 for r in found if r.query_id == "x@1"} == {7} and len({r.doc_id % 8 for r in found if r.query_id == "y"}) > 1


def test_a_failed_variant_is_left_out_and_the_others_are_fused(spark, store_of):
    chunks, index = store_of
    vectors = models.embed_documents(chunks).select("chunk_id", "vector")

    def picky(texts):
        if any("poison" in t for t in texts):
            raise RuntimeError("no")
        return models.hashed_embedding(texts)

    def embed(df, text):
        return models.map_model(df, picky, column=text, out="vector", kind="array<float>", attempts=1, failed="error").drop("error")

    live = spark.createDataFrame([("a", "topic1 explains", ["poison topic2"]), ("b", "poison topic3", ["poison too"]), ("c", "topic1 explains", [])], "query_id string, text string, others array<string>")
    live = live.withColumns({"sub": F.col("text"), "round": F.lit(0), "doc_filter": F.lit(None).cast("string")})
    got = retrieve(live, chunks, index, vectors=vectors, embed=embed).collect()
    by = {q: sorted((r.rerank, r.doc_id, r.rrf_score) for r in got if r.query_id == q) for q in "abc"}
    assert by["a"] == by["c"] and by["a"] and by["b"] == []


def test_a_hanging_model_costs_its_deadline(spark):
    def hangs(texts):
        if "slow" in texts:
            time.sleep(30)
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(1, "slow"), (2, "quick"), (3, None)], "id int, text string").coalesce(1)
    began = time.time()
    got = {r.id: (r.said, r.error) for r in models.map_model(df, hangs, column="text", out="said", kind="string", attempts=1, deadline=0.5, failed="error").collect()}
    assert time.time() - began < 20 and got[2] == ("QUICK", None) and got[3] == (None, None)
    assert got[1][0] is None and "no answer within 0.5 s" in got[1][1]
    with pytest.raises(models.ModelTimeout):
        models.with_retry(models.with_deadline(lambda _: time.sleep(5), 0.05), 2, sleep=lambda s: None)([1])
    with pytest.raises(ZeroDivisionError):
        models.with_deadline(lambda: 1 / 0, 1)()


def test_answers_of_graders_and_routers(spark):
    row = spark.range(1).select(
        routing.validated(F.lit("no json")).alias("bare"), routing.validated(F.lit(None).cast("string")).alias("none"),
        routing.covered_by(F.array(F.lit("1"), F.lit("ALPHA"), F.lit("9")), F.array(F.lit("what is alpha"), F.lit("beta"), F.lit("gamma"))).alias("covered"),
        routing.deep_completeness(F.lit('{"sufficient": false, "gaps": ["x"], "can_partially_answer": true}')).alias("deep"),
        routing.overall_score(F.lit(0.25), F.lit(0.5), F.lit("adequate"), F.lit("factual")).alias("half"), routing.texts_of(F.lit('```json\n["a", " ", "b"]\n```')).alias("texts"),
    ).first()
    assert not row.bare.requires_confirmation and row.bare.fallback_categories == [] and row.bare.confidence == 0.6 and row.none == row.bare
    assert row.covered == [0, 1] and row.texts == ["a", "b"]
    assert (row.deep.level, row.deep.missing_critical_info, row.deep.gaps, row.deep.can_partially_answer, row.deep.confidence) == ("insufficient", True, ["x"], True, 0.5)


def test_two_digits_are_rounded_as_python_rounds_them(spark):
    import math
    import random

    rng = random.Random(6)
    values = [k / 200 for k in range(201)] + [k / 1000 for k in range(1001)] + [rng.random() for _ in range(3000)]
    values += [math.nextafter(v, way) for v in values[:201] for way in (0.0, 1.0)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", routing.hundredths(F.col("v")).alias("r")).collect()
    assert all(r.r == round(r.v, 2) for r in got)
    weights = [(0.5 * r + 0.2 * c + 0.3 * s, r, c) for r in (0.25, 0.35, 0.125) for c in (0.5, 1.0) for s in (0.7,)]
    for total, r, c in weights:
        score = spark.range(1).select(routing.overall_score(F.lit(r), F.lit(c), F.lit("adequate"), F.lit("factual")).alias("s")).first().s
        assert score == round(total, 2)
