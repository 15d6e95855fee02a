"""The versioned lexical index: edits, removals, compaction, and searches that skip, against a plain BM25."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryline.operators import lexical, retrieval

DOCS = "doc_id long, text string"


def plain_bm25(docs, asked, k):
    words = {i: (t or "").lower().split() for i, t in docs}
    n, avgdl = len(words), sum(map(len, words.values())) / max(1, len(words))
    df = Counter(w for ws in words.values() for w in set(ws))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / max(1, len(raw))
    out = []
    for q, text in asked:
        scores = []
        for i, ws in words.items():
            tf = Counter(ws)
            s = sum((floor if raw[w] < 0 else raw[w]) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / avgdl)) for w in (text or "").lower().split() if w in tf)
            if round(s, 6) > 0:
                scores.append((-round(s, 6), i))
        out += [(q, i, -s, rank) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def found(index, spark, asked, k):
    return [tuple(r) for r in retrieval.bm25_search(index, spark.createDataFrame(asked, "query_id long, text string"), k=k).select("query_id", "doc_id", "score", "rank").orderBy("query_id", "rank").collect()]


def same(got, want):
    return [(q, r) for q, _, _, r in got] == [(q, r) for q, _, _, r in want] and all(a[1] == b[1] and abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(rng.choices(vocab, weights, k=rng.randint(0, 60)))) for i in range(n)] + [(n, None), (n + 1, "  \t "), (n + 2, "Straße ÉCOLE w1")]


def asked_of(seed, n=25):
    rng = random.Random(seed)
    return [(q, " ".join(rng.choice([f"w{rng.randint(0, 20)}", f"w{rng.randint(0, 310)}"]) for _ in range(rng.randint(1, 14)))) for q in range(n)] + [(90, None), (91, "nothing here"), (92, "école straße")]


@pytest.mark.parametrize("k", [1, 5, 40])
def test_skipping_changes_no_rank(spark, monkeypatch, k):
    monkeypatch.setattr(lexical, "BUCKET_DOCS", 16)
    docs = corpus(1, 400)
    index = retrieval.build_index(spark.createDataFrame(docs, DOCS))
    assert index.buckets > 20 and same(found(index, spark, asked_of(2), k), plain_bm25(docs, asked_of(2), k))


def test_common_words_only(spark):
    docs = [(i, "the same words the") for i in range(6)] + [(6, "the other"), (7, "words")]
    index = retrieval.build_index(spark.createDataFrame(docs, DOCS))
    asked = [(1, "the same"), (2, "the words"), (3, "other the")]
    assert same(found(index, spark, asked, 3), plain_bm25(docs, asked, 3))


def test_the_index_follows_its_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "MOST_SEGMENTS", 3)
    folder, docs, rng = f"file://{tmp_path}/index", dict(corpus(3, 200)), random.Random(4)
    assert retrieval.load_index(spark, folder) is None
    table = lambda: spark.createDataFrame(sorted(docs.items()), DOCS).repartition(3)
    index, changed = retrieval.bootstrap_index(table(), folder)
    assert changed and index.n_docs == len(docs)
    again, changed = retrieval.bootstrap_index(table().repartition(7), folder)
    assert not changed and again.version == index.version
    for step in range(4):
        # The count stays: as many documents come as go, and some are edited.
        gone = rng.sample(sorted(docs), 3)
        for i in gone:
            del docs[i]
        edited = rng.sample(sorted(docs), 4)
        docs |= {i: f"edited {step} w{i % 7} w{step}" for i in edited} | {1000 + 3 * step + j: f"new w{j} edited" for j in range(3)}
        index, took = retrieval.sync(table(), folder)
        assert took == {"added": 7, "removed": 7} and index.n_docs == len(docs)
        asked = [(1, "edited w3"), (2, f"{step} w1 w2"), (3, "w0 new")]
        assert same(found(index, spark, asked, 10), plain_bm25(docs.items(), asked, 10))
    fresh = retrieval.build_index(table())
    got, want = ({(r.term, r.df): r.idf for r in x.terms.collect()} for x in (index, fresh))
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want) and len(index.segments) <= 3
    assert abs(index.floor - fresh.floor) < 1e-9 and index.signature == fresh.signature


def test_a_change_writes_its_own_documents_only(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    docs = dict(corpus(5, 300))
    retrieval.sync(spark.createDataFrame(sorted(docs.items()), DOCS), folder)
    docs[7] = "one edited text"
    index, took = retrieval.sync(spark.createDataFrame(sorted(docs.items()), DOCS), folder)
    assert took == {"added": 1, "removed": 1} and index.segments == [0, 1]
    assert index.table("postings", [1]).count() == 3 and index.table("forward", [1]).count() == 1


def test_a_search_reads_the_asked_shards_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", 100)
    docs = corpus(6, 300)
    index = retrieval.build_index(spark.createDataFrame(docs, DOCS), folder=f"file://{tmp_path}/index")
    assert index.shards > 20
    hits = retrieval.bm25_search(index, spark.createDataFrame([(1, "w5")], "query_id long, text string"))
    plan = hits._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    shard = spark.createDataFrame([("w5",)], "term string").select(lexical._shard(index.shards)).first().shard
    assert "PartitionFilters: [isnotnull(shard" in plan and f"= {shard})" in plan
    assert same([tuple(r) for r in hits.select("query_id", "doc_id", "score", "rank").orderBy("rank").collect()], plain_bm25(docs, [(1, "w5")], 10))


def test_string_ids_and_an_empty_table(spark):
    index = retrieval.build_index(spark.createDataFrame([("a@1", "x y"), ("b", "y")], "id string, text string"), key="id")
    hits = retrieval.bm25_search(index, spark.createDataFrame([("q", "x")], "query_id string, text string")).collect()
    assert [(r.query_id, r.doc_id) for r in hits] in ([("q", "a@1")], [])  # two documents: the weight may be nought
    none = retrieval.build_index(spark.createDataFrame([], DOCS))
    assert none.n_docs == 0 and retrieval.bm25_search(none, spark.createDataFrame([(1, "x")], "query_id long, text string")).collect() == []
    assert retrieval.bm25_search(index, spark.createDataFrame([("q", None)], "query_id string, text string")).where(F.lit(True)).collect() == []


def test_texts_are_cut_by_runs_of_bounded_bytes(monkeypatch):
    monkeypatch.setattr(lexical, "CUT_BYTES", 40)
    texts = ["a b a", "", "  x\ty\nx ", "w" * 50, " ".join(f"v{i % 7}" for i in range(60)), "caf\u00e9 caf\u00e9", " "]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "s1": [0] * 7, "s2": [0] * 7, "text": texts})
    parts = list(lexical._term_counts([batch]))
    assert len(parts) > 3
    rows = [r for p in parts for r in p.to_pylist()]
    assert [(r["doc_id"], r["dl"], dict(zip(r["terms"], r["tfs"], strict=True))) for r in rows] == [(i, len(t.split()), dict(Counter(t.split()))) for i, t in enumerate(texts)]


def test_queries_and_documents_of_several_cells_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BUCKET_DOCS", 16)
    monkeypatch.setattr(lexical, "QUERY_ROWS", 5)
    monkeypatch.setattr(lexical, "PART_POSTINGS", 50)
    docs = corpus(8, 300) + [(1000 + i, "w1 w2 copies") for i in range(60)]
    index = retrieval.build_index(spark.createDataFrame(docs, DOCS))
    asked = [*asked_of(9), (200, "copies w2")]
    assert same(found(index, spark, asked, 7), plain_bm25(docs, asked, 7))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_an_index_without_postings_finds_the_same(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(lexical, "HELD_SCORES", 28 * 9)  # runs of nine documents
    folder, docs, asked = f"file://{tmp_path}/index", dict(corpus(11, 300)), [*asked_of(12), (200, "w2 w0")]
    table = lambda: spark.createDataFrame(sorted(docs.items()), DOCS).repartition(3)
    index = retrieval.sync(table(), folder, inverted=False)[0]
    assert not (tmp_path / "index" / "postings").exists()
    assert same(found(index, spark, asked, 7), plain_bm25(docs.items(), asked, 7))
    assert {(r.term, r.df) for r in index.terms.collect()} == set(Counter(w for t in docs.values() for w in set((t or "").lower().split())).items())
    docs[7], docs[999] = "one edited w2 text", "w0 w0"
    del docs[9]
    index, took = retrieval.sync(table(), folder)
    assert took == {"added": 2, "removed": 2} and not index.inverted and not (tmp_path / "index" / "postings").exists()
    want = plain_bm25(docs.items(), asked, 7)
    assert same(found(index, spark, asked, 7), want)
    pairs = spark.createDataFrame([(200, 7), (200, 999), (200, 1)], "query_id long, doc_id long")
    within = [index_.doc_id for index_ in retrieval.bm25_within(index, spark.createDataFrame([(200, "w2 edited")], "query_id long, text string"), pairs).collect()]
    assert within[0] == 7 and 999 not in within
    monkeypatch.setattr(lexical, "QUERY_ROWS", 5)  # more queries than are sent: the grid, over forward rows
    assert same(found(index, spark, asked, 7), want)
