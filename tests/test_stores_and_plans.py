"""Stores, parsers, the model seam, streams over several batches, and the answer loop."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarryline.functions import ids, text
from quarryline.operators import chunking, context, memory, models, parsing, retrieval, routing
from quarryline.plans.answer import answer
from quarryline.sources import files, parsers, store
from quarryline.streaming import streams


def test_blob_store(spark, tmp_path):
    blobs = store.make_store("local", spark, f"file://{tmp_path}/blobs")
    assert blobs.list().count() == 0 and not blobs.exists("a/x.json")
    blobs.upload("a/x.json", [{"id": 1, "name": "item1", "value": 10.5}], meta={"by": "test"})
    blobs.upload("a/y.bin", b"\x00\x01")
    blobs.upload("a/y.bin", b"\x02")
    assert json.loads(blobs.download("a/x.json")) == [{"id": 1, "name": "item1", "value": 10.5}]
    assert blobs.download("a/y.bin") == b"\x02" and blobs.meta("a/x.json") == {"by": "test"} and blobs.meta("a/y.bin") is None
    assert {r.key for r in blobs.list("a/").collect()} == {"a/x.json", "a/y.bin"} and blobs.list("b").count() == 0
    assert blobs.delete("a/x.json") and not blobs.delete("a/x.json") and not blobs.exists("a/x.json.meta")
    with pytest.raises(FileNotFoundError):
        blobs.download("a/x.json")
    for key in ("../x", "/x", "a/../../x", ""):
        with pytest.raises(ValueError):
            blobs.path(key)
    with pytest.raises(ValueError):
        store.make_store("tape", spark, "file:///x")


def test_parse_cache_evicts_itself(spark, tmp_path):
    cache = store.ParseCache(spark, f"file://{tmp_path}/cache")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "cache_key string")
    assert {r.parsed for r in cache.get(keys).collect()} == {None}
    cache.store(spark.createDataFrame([("a", "f1", '{"x": 1}'), ("b", "f2", "{broken")], "cache_key string, source_file string, parsed string"))
    assert {(r.cache_key, r.parsed) for r in cache.get(keys).collect()} == {("a", '{"x": 1}'), ("b", None), ("c", None)}
    cache.store(spark.createDataFrame([("c", "f1", "[]")], "cache_key string, source_file string, parsed string"))
    assert {r.cache_key for r in cache.entries().collect()} == {"a", "c"}
    assert cache.invalidate("f1") == 2 and cache.invalidate("f1") == 0 and cache.entries().count() == 0


def test_parsers_by_range(spark, tmp_path):
    content = "\f".join(f"page {i}" for i in range(45)).encode()
    docs = spark.createDataFrame([("a.txt", bytearray(content)), ("b.txt", bytearray(b""))], "path string, content binary")
    got = {r.path: (r.text, r.error) for r in parsers.parse_files(docs).collect()}
    assert got["a.txt"][0] == "".join("\f".join(f"page {i}" for i in range(a, min(a + 20, 45))) + "\n" for a in (0, 20, 40)) and got["b.txt"] == ("\n", None)

    def fails(path, data, first, end):
        raise ValueError("no")

    parsers.PARSERS.register("Fails Always", lambda: fails)
    got = parsers.file_status(parsers.parse_files(docs, " fails always ")).collect()
    assert all(not r.ok and "ValueError: no" in r.error for r in got)
    with pytest.raises(ValueError):
        parsers.PARSERS.make("none")
    made = []
    reg = parsers.Registry("thing")
    reg.register("one", lambda **o: made.append(o) or object(), shared=True)
    assert reg.make("one", a=1, b=None) is reg.make("ONE", a=1) and made == [{"a": 1}]
    routes = spark.createDataFrame([("x.pdf",), ("x.html",), ("x.zip",)], "path string")
    assert [r.route for r in parsers.with_mime(routes).orderBy("path").collect()] == ["html", "pdf", "quarantine"]
    assert files.scan_files(spark, [f"file://{tmp_path}/nowhere"]).count() == 0


def test_model_seam(spark):
    calls = []

    def flaky(items):
        calls.append(len(items))
        if len(calls) < 3:
            raise TimeoutError("slow")
        return [x * 2 for x in items]

    slept = []
    assert models.with_retry(flaky, 3, sleep=slept.append)([1, 2]) == [2, 4] and slept == [1.0, 2.0]
    with pytest.raises(models.ModelTimeout):
        models.with_retry(lambda _: (_ for _ in ()).throw(TimeoutError()), 2, sleep=lambda s: None)([1])
    with pytest.raises(models.ModelError):
        models.batched(lambda items: items[:1], 2)([1, 2, 3])
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "a b")], "id int, text string")
    got = {r.id: r.vector for r in models.embed_documents(docs).collect()}
    assert got[1] == got[4] and len(got[1]) == 64 and got[2] is None and not any(got[3])
    with pytest.raises(Exception, match="empty question"):
        models.embed_queries(docs).collect()

    def broken(items):
        raise RuntimeError("down")

    out = models.map_model(docs, broken, column="text", out="said", kind="string", attempts=1, default="none")
    assert {r.id: r.said for r in out.collect()} == {1: "none", 2: None, 3: "none", 4: "none"}
    assert models.default_json({"b": {2, 1}, "a": (1, None)}) == '{"a": [1, null], "b": [1, 2]}'


def test_dense_search_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(300)] + [(300, None), (301, [0.0] * 4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked = table.where("vec_id % 20 = 0 and vec_id < 300").withColumnRenamed("vec_id", "query_id")
    one = sorted(map(tuple, retrieval.dense_search(table, asked, k=7).collect()))
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 4)
    monkeypatch.setattr(retrieval, "VECTOR_ROWS", 50)
    assert sorted(map(tuple, retrieval.dense_search(table, asked, k=7).collect())) == one and len(one) == 15 * 7


def test_an_emptied_document_loses_its_chunks(spark, tmp_path):
    folder, kind = f"file://{tmp_path}/store", "doc_id string, chunk_index int, text string"
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    store.dump_ingest(spark.createDataFrame([("a", 0, "x"), ("b", 0, "y"), ("c", 0, "z")], kind), None, folder)
    store.dump_ingest(spark.createDataFrame([("b", 0, "new")], kind), spark.createDataFrame([("b", 0, [1.0])], "doc_id string, chunk_index int, vector array<double>"), folder, documents=docs)
    assert {(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/chunks").collect()} == {("b", "new"), ("c", "z")}
    assert [r.vector for r in spark.read.parquet(f"{folder}/embedded_chunks").collect()] == [[1.0]]
    store.dump_ingest(spark.createDataFrame([], kind), None, folder, documents=docs)
    assert [r.doc_id for r in spark.read.parquet(f"{folder}/chunks").collect()] == ["c"]


def test_packed_spans():
    rng = random.Random(2)
    for _ in range(300):
        lengths = [rng.randint(0, 6) for _ in range(rng.randint(1, 12))]
        gap, size, overlap = rng.randint(0, 2), rng.randint(7, 14), rng.randint(0, 6)
        spans = chunking.packed_spans(lengths, gap, size, overlap)
        cost = lambda i, j: sum(lengths[i:j]) + gap * max(0, j - i - 1)
        assert spans[0][0] == 0 and spans[-1][1] == len(lengths)
        for (a, b), nxt in zip(spans, [*spans[1:], None], strict=True):
            assert a < b and (cost(a, b) <= size or b == a + 1)
            if nxt:
                fits = [k for k in range(a, b) if cost(k, b) <= overlap and cost(k, b + 1) <= size]
                assert cost(a, b + 1) > size and nxt[0] == (fits[0] if fits else b) and nxt[1] > b


def test_layout_with_a_cycle():
    tree = {"body": {"children": [{"$ref": "#/groups/0"}]}, "groups": [{"children": [{"$ref": "#/texts/0"}, {"$ref": "#/groups/0"}, {"$ref": "#/body"}]}], "texts": [{"label": "text", "orig": "Hello World"}]}
    assert [b["text"] for b in parsing.layout_blocks(tree)] == ["Hello World"]


def test_main_content(spark):
    pages = spark.createDataFrame([(1, "<nav><p>go somewhere else, please do</p></nav><main><h1>Title</h1><p>the content that matters here</p></main>"), (2, "<p>only a paragraph of some length</p><footer><p>all rights reserved by nobody</p></footer>"), (3, None)], "page_id long, html string")
    got = {r.page_id: r.text for r in parsing.main_content(pages).collect()}
    assert got == {1: "Title\n\nthe content that matters here", 2: "only a paragraph of some length"}


def test_text_functions(spark):
    rows = spark.createDataFrame([(1, "it says h e l l o ’ w here  now", 'pa"th\\x')], "id int, t string, p string")
    r = rows.select(text.ocr_clean(F.col("t")).alias("t"), ids.cache_key(F.col("p"), F.lit(1.5), F.lit("x"), F.lit("auto")).alias("k"), ids.output_dir(F.lit("a/b.c.pdf")).alias("d")).first()
    import hashlib

    want = json.dumps({"file_path": 'pa"th\\x', "mtime": 1.5, "parse_method": "auto", "parser": "x"}, sort_keys=True)
    assert r.t == "it says hello’w here now" and r.k == hashlib.md5(want.encode()).hexdigest()
    assert r.d == "b.c_" + hashlib.md5(b"a/b.c.pdf").hexdigest()[:8]
    assert text.json_or is not None and rows.select(text.json_or(F.lit("?"), "[]").cast("string").alias("j")).first().j == "[]"


def test_ingest_stream_over_several_batches(spark, tmp_path):
    folder = f"{tmp_path}/in"
    versions = [[(i, 0, f"first {i}", 1) for i in range(50)], [(i, 0, f"second {i}", 2) for i in range(0, 50, 7)] + [(3, 0, "late", 0)], [(99, 1, "new", 3)]]
    for rows in versions:
        spark.createDataFrame(rows, "doc_id long, chunk_index int, text string, ingest_ts long").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("doc_id long, chunk_index int, text string, ingest_ts long").parquet(folder)
        streams.ingest_stream(stream, f"file://{tmp_path}/table", f"file://{tmp_path}/checkpoint").awaitTermination()
    got = {(r.doc_id, r.chunk_index): r.text for r in streams.read_ingested(spark, f"file://{tmp_path}/table").collect()}
    want = {}
    for rows in versions:
        want |= {(d, c): t for d, c, t, v in rows if t != "late"}
    assert got == want
    assert len(list((tmp_path / "table" / "version=2").glob("part=*"))) == 1  # the last batch touched one part


def test_listing_and_disk_follow_the_table_not_the_batches(spark, tmp_path):
    target, want = f"file://{tmp_path}/table", {}
    for epoch in [*range(12), 11]:  # the last one is repeated
        rows = [(i, 0, f"{epoch}:{i}", epoch) for i in range(epoch % 3, 30, 3)]
        streams.merge_batch(spark.createDataFrame(rows, "doc_id long, chunk_index int, text string, ingest_ts long"), epoch, target, parts=4)
        want |= {i: t for i, _, t, _ in rows}
        assert len(list((tmp_path / "table" / "manifest").glob("*.json"))) <= streams.KEPT
        assert len(list((tmp_path / "table").glob("version=*/part=*"))) <= 4 * streams.KEPT
        assert all(len(list(p.glob("*.parquet"))) == 1 for p in (tmp_path / "table").glob("version=*/part=*"))
    assert {r.doc_id: r.text for r in streams.read_ingested(spark, target).collect()} == want
    earlier = {r.doc_id: r.text for r in streams.read_ingested(spark, target, 10).collect()}
    assert earlier == want | {i: f"8:{i}" for i in range(2, 30, 3)}


def test_one_source_of_all_rows_fits_its_budget_in_many_tasks(spark):
    rng = random.Random(8)
    rows = [("hot", i, "x" * rng.randint(0, 30)) for i in range(3000)] + [(None, i, "y" * 9) for i in range(40)] + [("small", 1, "z" * 500), ("small", 2, "z")]
    df = spark.createDataFrame(rows, "source string, place long, part string").repartition(6)
    for budget in (100, 499, 500, 20_000, 10**9):
        want = set()
        for by in ("hot", None, "small"):
            used = -len(context.SEPARATOR)
            for _, i, p in sorted((r for r in rows if r[0] == by), key=lambda r: r[1]):
                used += len(p) + len(context.SEPARATOR)
                if used <= budget:
                    want.add((by, i, used))
        got = context.within_budget(df, by="source", order="place", budget=budget)
        assert {(r.source, r.place, r.used) for r in got.collect()} == want


def test_chunks_from_sql(spark):
    docs = spark.createDataFrame([(1, " one  two\nthree four five ", "a"), (2, None, "b"), (3, "  ", "c"), (4, "x\u00a0y z", "d")], "id int, body string, note string")
    docs.createOrReplaceTempView("docs_for_sql")
    name = chunking.register(spark, "cut_text")
    got = spark.sql(f"SELECT * FROM {name}(TABLE(docs_for_sql), 'body', 3, 1)").collect()
    want = chunking.fixed_windows(docs, text="body", size=3, overlap=1).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 4
    for bad in ("'nothing', 3, 1", "'body', 3, 3"):
        with pytest.raises(Exception, match="no column|smaller than"):
            spark.sql(f"SELECT * FROM {name}(TABLE(docs_for_sql), {bad})").collect()


def run_sessions(spark, folder, batches, **how):
    """The rows that each batch of (session, turn, role, text, second) gives."""
    start, seen = pd.Timestamp("2024-01-01", tz="UTC"), []
    for rows in batches:
        table = [(s, t, r, x, (start + pd.Timedelta(seconds=at)).to_pydatetime()) for s, t, r, x, at in rows]
        spark.createDataFrame(table, "session_id string, turn long, role string, text string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/turns")
        stream = spark.readStream.schema("session_id string, turn long, role string, text string, ts timestamp").parquet(f"{folder}/turns")
        got = []
        out = streams.session_stream(stream, **how)
        out.writeStream.outputMode("update").foreachBatch(lambda b, _, got=got: got.extend(b.collect())).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        seen.append(got)
    return seen


def test_sessions_expire(spark, tmp_path):
    batches = [[("a", 0, "user", "one ␞ two", 0), ("b", 0, "user", "hello", 10)], [("a", 1, "assistant", None, 60)], [("c", 0, "user", "much later", 5 * 3600)], [("c", 1, "user", "later still", 6 * 3600)]]
    seen = [r for got in run_sessions(spark, tmp_path, batches, keep=3) for r in got]
    ended = {r.session_id: (r.n_turns, r.recent) for r in seen if r.expired}
    assert ended == {"a": (2, ["user: one ␞ two", "assistant: "]), "b": (1, ["user: hello"])}
    assert max(r.n_turns for r in seen if r.session_id == "c") == 2


def test_a_late_turn_neither_ends_a_session_nor_leaves_its_place(spark, tmp_path):
    minute = 60
    batches = [
        [("s", 0, "user", "first", 0), ("s", 2, "user", "third", 60 * minute)],
        [("s", 1, "assistant", "second", 52 * minute), ("other", 0, "user", "x", 76 * minute)],  # the watermark goes to 66
        [("other", 1, "user", "y", 79 * minute)],  # 69: the session lives until 70
        [("other", 2, "user", "z", 81 * minute)],
    ]
    seen = run_sessions(spark, tmp_path, batches, ttl_s=10 * minute, keep=2)
    assert [(r.n_turns, r.recent) for r in seen[1] if r.session_id == "s"] == [(3, ["assistant: second", "user: third"])]
    assert not any(r.expired for got in seen[:3] for r in got)
    assert [(r.session_id, r.n_turns, r.recent) for r in seen[3] if r.expired] == [("s", 3, ["assistant: second", "user: third"])]


def test_sessions_become_episodes(spark, tmp_path):
    turns = spark.createDataFrame([("s", "u", 0, "user", "what is retrieval", "2024-01-01 10:00:00"), ("s", "u", 1, "assistant", "a search", "2024-01-01 10:01:00")], "session_id string, user_id string, turn long, role string, text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    more = memory.add_turn(turns, turns.where("turn = 0").withColumn("text", F.lit("and then")))
    assert {(r.turn, r.text) for r in more.collect()} == {(0, "what is retrieval"), (1, "a search"), (2, "and then")}
    episodes = memory.compress_sessions(turns)
    memory.save_episodes(episodes, f"file://{tmp_path}/episodes")
    line = memory.load_episodes(spark, f"file://{tmp_path}/episodes", spark.createDataFrame([("u",)], "user_id string")).first().line
    assert line.startswith("[2024-01-01 10:01 | Topics: ") and line.endswith("] User: what is retrieval\nAssistant: a search")
    dumped = memory.compress_sessions(turns, model=lambda t: F.lit("no json")).first()
    assert dumped.summary == "" and dumped.topic_tags == [] and dumped.turn_count == 2


def test_acceptance_and_fallbacks(spark):
    row = spark.range(1).select(
        routing.acceptance(F.array().cast("array<int>"), F.array(F.lit(1))).alias("all"),
        routing.covered_with_fallback(F.lit(1), F.lit(4), F.lit(3)).alias("assessed"),
        routing.covered_with_fallback(F.lit(2), F.lit(4), F.lit(4)).alias("counted"),
        routing.covered_with_fallback(F.lit(1), F.lit(4), F.lit(None).cast("int")).alias("nothing"),
        routing.overall_score(F.lit(0.25), F.lit(0.5), F.lit("adequate"), F.lit("factual")).alias("two_digits"),
        context.previews(F.array(F.lit("abc"), F.lit("d")), 2).alias("previews"),
    ).first()
    assert row["all"] == [1] and row.assessed == 0.75 and row.counted == 0.5 and row.nothing == 0.0
    assert row.two_digits == round(0.5 * 0.25 + 0.2 * 0.5 + 0.3 * 0.7, 2) and row.previews == "Chunk 0: ab...\nChunk 1: d..."


def test_answer_walks_every_route(spark):
    chunks = [(i, f"topic{i % 6} explains part {i} of the matter with words{i}", f"s{i % 3}", f"sec{i % 2}") for i in range(40)]
    table = spark.createDataFrame(chunks, "chunk_id long, text string, source string, section string")
    asked = [(1, "hello there"), (2, "what is topic1"), (3, "compare topic2 explains with topic3 explains"), (4, "why did zzz qqq happen to xyz at all"), (5, "summarize our conversation")]
    index = retrieval.build_index(table, key="chunk_id")
    got = {r.question_id: r for r in answer(spark.createDataFrame(asked, "question_id long, question string"), table, index).collect()}
    assert {i: r.route for i, r in got.items()} == {1: "simple_response", 2: "direct_synthesize", 3: "plan", 4: "plan", 5: "synthesize"}
    assert got[1].steps == 0 and got[1].answer.startswith("Hello") and got[1].sources is None
    assert got[2].steps >= 1 and got[2].n_accepted >= 1 and got[2].answer.startswith("From the documents: ") and got[2].sources == ["s1"]
    assert got[3].category == "comparative" and got[3].coverage == 1.0 and got[3].steps >= 2
    # Nothing is found: each half is refined until the rounds end, then the guard speaks.
    assert got[4].n_accepted == 0 and got[4].steps == 4 and got[4].needs_refinement and got[4].answer == context.NO_CONTEXT and got[4].score < 0.4
    vectors = models.embed_documents(table).select("chunk_id", "vector")
    dense = {r.question_id: r for r in answer(spark.createDataFrame(asked, "question_id long, question string"), table, index, vectors=vectors, embed=models.embed_queries).collect()}
    assert dense[2].n_accepted >= 1 and dense[4].steps >= 1


def test_answer_questions_neither_sorts_postings_nor_shuffles_chunks(spark):
    """Its index serves one batch of questions: the forward rows are read once a pass, and the few hits go to the chunks."""
    from pathlib import Path

    from quarryline.plans import catalogue
    from quarryline.sources import store

    root = Path(store.shared_root(spark).removeprefix("file:"))
    before = set(root.iterdir())
    rows = catalogue.queries()["answer_questions"](spark, "/root/testdata/sf0.001").collect()
    made = {p.name.split("-")[0]: p for p in set(root.iterdir()) - before}
    assert rows and {"index", "hits"} <= set(made)
    assert (made["index"] / "forward").exists() and not (made["index"] / "postings").exists()


def test_command_line(spark, tmp_path):
    from quarryline.__main__ import main

    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.txt").write_text("first page\fsecond page")
    (tmp_path / "files" / "a.zip").write_text("no")
    (tmp_path / "files" / "b.html").write_text("<h1>Title</h1><p>a paragraph that is long enough</p><nav>menu</nav>")
    (tmp_path / "files" / "c.pdf").write_bytes(b"%PDF-1.4 \xff\xfe")
    main(["parse", f"file://{tmp_path}/files", f"file://{tmp_path}/nowhere", "--out", f"file://{tmp_path}/parsed"])
    got = {r.path.rpartition("/")[2]: r for r in spark.read.json(f"{tmp_path}/parsed").collect()}
    assert got["a.txt"].text == "first page\fsecond page\n" and got["b.html"].text == "Title\n\na paragraph that is long enough\n"
    assert got["c.pdf"].text is None and got["c.pdf"].error == "quarantined: no parser for .pdf" and len(got) == 3
    spark.createDataFrame([(i, f"topic{i % 5} is explained in part {i}", f"s{i}") for i in range(30)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(1, "what is topic2"), (2, "hello")], "question_id long, question string").write.parquet(f"{tmp_path}/asked")
    main(["ingest", f"file://{tmp_path}/docs", "--out", f"file://{tmp_path}/store"])
    main(["query", f"file://{tmp_path}/asked", "--store", f"file://{tmp_path}/store", "--out", f"file://{tmp_path}/said"])
    got = {r.question_id: r for r in spark.read.parquet(f"{tmp_path}/said").collect()}
    assert got[1].n_accepted >= 2 and "topic2" in got[1].answer and got[2].route == "simple_response"


def test_a_second_ingest_writes_its_parts_once(spark, tmp_path, monkeypatch):
    scratch, plain = [], store.written
    monkeypatch.setattr(store, "written", lambda df, path: scratch.append(df.columns) or plain(df, path))
    rows = lambda ids, said: spark.createDataFrame([(i, j, f"{said} {i} {j}") for i in ids for j in range(2)], "doc_id long, chunk_index int, chunk_text string")
    store.dump_ingest(rows(range(90), "old"), None, str(tmp_path))
    store.dump_ingest(rows(range(0, 90, 3), "new"), None, str(tmp_path))
    got = {(r.doc_id, r.chunk_index): r.chunk_text for r in spark.read.parquet(f"{tmp_path}/chunks").collect()}
    assert got == {(i, j): f"{'old' if i % 3 else 'new'} {i} {j}" for i in range(90) for j in range(2)}
    assert all("chunk_text" not in columns for columns in scratch) and [p.name for p in tmp_path.iterdir()] == ["chunks"]


def test_texts_reach_the_chunker_in_sql_by_bounded_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        chunking.register(spark)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= 8 << 20
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
