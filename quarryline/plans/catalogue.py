"""The retrieval engine's queries, each with the SQL that an oracle can run over the same tables.

Documents and vectors have no common key in the test tables: by convention of this catalogue
``embeddings.vec_id`` is the vector of the document of that id, and a benchmark item's own
vector is that of its id. Dense ranks there exercise the operator; they say nothing of meaning.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import ids, text
from quarryline.operators import chunking, context, memory, models, parsing, retrieval, routing
from quarryline.sources import files, parsers, store
from quarryline.streaming import streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def T(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _index(spark, d) -> retrieval.LexicalIndex:
    """The documents' index: one a session and table, brought up to the table each time it is asked for."""
    folder = f"{store.shared_root(spark)}/bm25-{spark.sparkContext.applicationId}-{zlib.crc32(d.encode()):08x}"
    return retrieval.bootstrap_index(T(spark, d, "documents"), folder)[0]


_WORDS = r"list_filter(regexp_split_to_array(lower({}), '\s+'), lambda x: x <> '')"

#: Categories by number, typed here so that a wrong one in the engine shows.
_CATEGORY_SQL = "['factual', 'comparative', 'analytical', 'summarization', 'chitchat', 'clarification', 'procedural', 'meta'][({} % 8 + 1)::INT]"
_CATEGORY_NAMES = ("factual", "comparative", "analytical", "summarization", "chitchat", "clarification", "procedural", "meta")


def _nth(values, place):
    """The value of a fixed list at a place that a row gives, from 0, around."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(place, F.lit(len(values))) + 1).cast("int"))


# ---------------------------------------------------------------- chunking

_CHUNKS = r"""
SELECT doc_id, ci::INT AS chunk_index, regexp_replace(array_to_string(w[ci * {step} + 1 : ci * {step} + {size}], ''), '^\s+', '') AS chunk_text
FROM (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // {step} + 1)) AS ci
      FROM (SELECT doc_id, regexp_extract_all(text, '\s*\S+') AS w FROM documents) WHERE len(w) > 0)
"""


@query(_CHUNKS.format(step=448, size=512))
def chunk_fixed_window(spark, d):
    return chunking.fixed_windows(T(spark, d, "documents")).select("doc_id", "chunk_index", "chunk_text")


@query(_CHUNKS.format(step=100, size=128))
def chunk_text_udtf(spark, d):
    """The chunker as a table function in SQL."""
    T(spark, d, "documents").createOrReplaceTempView("quarryline_documents")
    chunk = chunking.register(spark)
    return spark.sql(f"SELECT doc_id, chunk_index, chunk_text FROM {chunk}(TABLE(SELECT doc_id, text FROM quarryline_documents) PARTITION BY (doc_id), 'text', 128, 28)")


@query(f"""SELECT doc_id, count(*) AS n_chunks, sum(length(chunk_text))::BIGINT AS n_chars, max(chunk_index) AS last_index
FROM ({_CHUNKS.format(step=32, size=40)}) GROUP BY doc_id""")
def chunk_window_stats(spark, d):
    chunks = chunking.fixed_windows(T(spark, d, "documents"), size=40, overlap=8)
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("chunk_text").cast("long")).alias("n_chars"), F.max("chunk_index").alias("last_index"))


@query(r"""SELECT conv_id, turn, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS parent_text,
greatest(0, row_number() OVER o - 2)::INT AS parent_start, least(count(*) OVER (PARTITION BY conv_id), row_number() OVER o + 1)::BIGINT AS parent_end
FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)""")
def chunk_parent_window(spark, d):
    out = chunking.parent_windows(T(spark, d, "conversations"), doc="conv_id", index="turn")
    return out.select("conv_id", "turn", "parent_text", "parent_start", "parent_end")


_ENDINGS = (".html", ".HTM", ".v2/readme.md", ".docx", ".PDF", ".tar.gz", "", ".pptx", ".txt", ".pdf/scan.png", "/.hidden", ".xlsx", ".unknown")


@query(f"""SELECT doc_id, path, s AS suffix, CASE WHEN s = '.pdf' THEN 'pdf' WHEN s IN ('.html', '.htm', '.xhtml') THEN 'html'
WHEN s IN ('.doc', '.docx', '.ppt', '.pptx', '.xls', '.xlsx') THEN 'office' ELSE 'quarantine' END AS route,
CASE WHEN s IN ('.html', '.htm', '.xhtml', '.doc', '.docx', '.ppt', '.pptx', '.xls', '.xlsx', '.txt', '.md', '.pdf') THEN 'recursive_character' ELSE 'fixed' END AS strategy,
s IN ('.html', '.htm', '.xhtml', '.doc', '.docx', '.ppt', '.pptx', '.xls', '.xlsx', '.txt', '.md', '.pdf') AS supported
FROM (SELECT doc_id, path, CASE WHEN regexp_matches(name, '^.+[.][^.]+$') THEN lower(regexp_extract(name, '[.][^.]+$')) ELSE '' END AS s
      FROM (SELECT doc_id, path, regexp_extract(path, '[^/]*$') AS name FROM (SELECT doc_id, source || '/' || lang || doc_id || {list(_ENDINGS)}[(doc_id % {len(_ENDINGS)} + 1)::INT] AS path FROM documents)))""")
def chunk_strategy_route(spark, d):
    path = F.concat("source", F.lit("/"), "lang", F.col("doc_id").cast("string"), _nth(_ENDINGS, F.col("doc_id")))
    s = files.suffix(F.col("path"))
    return T(spark, d, "documents").select("doc_id", path.alias("path")).select("doc_id", "path", s.alias("suffix"), files.parse_route(F.col("path")).alias("route"), files.chunk_strategy(F.col("path")).alias("strategy"), s.isin(*files.SUPPORTED).alias("supported"))


@query()
def chunk_recursive(spark, d):
    return chunking.recursive_chunks(T(spark, d, "documents"))


@query("SELECT doc_id, n_pages, r.a::INT AS first_page, least(r.a + 20, n_pages)::INT AS end_page FROM (SELECT doc_id, n_pages, unnest(list_transform(range(0, n_pages, 20), lambda x: {'a': x})) AS r FROM (SELECT doc_id, (n_chars // 300)::INT AS n_pages FROM documents))")
def pdf_page_ranges(spark, d):
    pages = T(spark, d, "documents").select("doc_id", F.floor(F.col("n_chars") / 300).cast("int").alias("n_pages"))
    out = pages.select("doc_id", "n_pages", F.explode(files.page_ranges(F.col("n_pages"))).alias("r"))
    return out.select("doc_id", "n_pages", F.col("r.first").alias("first_page"), F.col("r.end").alias("end_page"))


# ---------------------------------------------------------------- text


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean, trim(regexp_replace(text, ' {2,}', ' ', 'g')) AS collapsed FROM documents")
def text_collapse_spaces(spark, d):
    return T(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("clean"), text.collapse_spaces(F.col("text")).alias("collapsed"))


#: Two runs may share a line feed or tab between them, so these stand twice while runs are marked.
_TWICE = r"regexp_replace(text, '([\t\n\f\r])', '\1' || chr(2) || '\1', 'g')"
_MARKED = f"regexp_replace({_TWICE}, '(^|\\s)((?:{text.SPELT} ){{4,}}{text.SPELT})(\\s|$)', '\\1' || chr(1) || '\\2' || chr(1) || '\\3', 'g')"
_JOINED = f"array_to_string(list_transform(string_split({_MARKED}, chr(1)), lambda p, i: CASE WHEN i % 2 = 0 THEN replace(p, ' ', '') ELSE p END), '')"


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace({_JOINED}, '(?s)(.)' || chr(2) || '.', '\\1', 'g'), ' {{2,}}', ' ', 'g')) AS clean FROM documents")
def text_ocr_clean(spark, d):
    return T(spark, d, "documents").select("doc_id", text.ocr_clean(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, len({_WORDS.format('text')})::BIGINT AS n_tokens, len(list_distinct({_WORDS.format('text')}))::BIGINT AS n_distinct FROM documents")
def text_tokens(spark, d):
    t = text.tokens(F.col("text"))
    return T(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


_MD_SQL = "replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
for _p, _r in (
    (r"\*\*(.*?)\*\*", r"<b>\1</b>"), ("__(.*?)__", r"<b>\1</b>"), ("`([^`]+?)`", r'<font name="Courier" size="9" color="darkred">\1</font>'),
    (r"\[([^\]]+?)\]\(([^)]+?)\)", r'<link href="\2" color="blue"><u>\1</u></link>'), ("~~(.*?)~~", r"<strike>\1</strike>"),
):
    _MD_SQL = f"regexp_replace({_MD_SQL}, '{_p}', '{_r}', 'g')"


@query(f"""SELECT conv_id, turn, {_MD_SQL} AS markup FROM (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN '**' || text || '** & __' || role || '__' WHEN 1 THEN 'a < b > ' || text || ' `' || text || '`'
WHEN 2 THEN '[' || role || '](http://x.y/' || conv_id || ') ' || text WHEN 3 THEN '~~' || text || '~~ kept' ELSE text END AS s FROM conversations)""")
def markdown_inline(spark, d):
    t, role = F.col("text"), F.col("role")
    said = F.when(F.col("turn") % 5 == 0, F.concat(F.lit("**"), t, F.lit("** & __"), role, F.lit("__"))).when(F.col("turn") % 5 == 1, F.concat(F.lit("a < b > "), t, F.lit(" `"), t, F.lit("`")))
    said = said.when(F.col("turn") % 5 == 2, F.concat(F.lit("["), role, F.lit("](http://x.y/"), F.col("conv_id").cast("string"), F.lit(") "), t)).when(F.col("turn") % 5 == 3, F.concat(F.lit("~~"), t, F.lit("~~ kept"))).otherwise(t)
    return T(spark, d, "conversations").select("conv_id", "turn", text.inline_markup(said, italics=False).alias("markup"))


_ANSWER_SQL = "'```json' || chr(10) || props || chr(10) || '```'"


@query(f"""SELECT event_id, json_extract_string(j, '$.k')::BIGINT AS k, json_valid(j) AS has_json FROM (
SELECT event_id, trim(regexp_extract(regexp_replace(regexp_replace(trim({_ANSWER_SQL}), '^```(?:json)?\\s*', ''), '\\s*```$', ''), '(\\{{.*\\}}|\\[.*\\])', 1, 's')) AS j FROM events)""")
def llm_json_extract(spark, d):
    raw = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return T(spark, d, "events").select("event_id", F.try_variant_get(text.parsed_json(raw), "$.k", "bigint").alias("k"), text.has_json(raw).alias("has_json"))


@query(f"SELECT conv_id, turn, round(len({_WORDS.format('text')}) / 0.75 * 1e-6, 12) AS cost FROM conversations")
def llm_cost_estimate(spark, d):
    return T(spark, d, "conversations").select("conv_id", "turn", F.round(text.cost_estimate(F.col("text")), 12).alias("cost"))


@query(f"SELECT role, count(*) AS calls, sum(len({_WORDS.format('text')}))::BIGINT AS tokens FROM conversations GROUP BY role")
def llm_usage_totals(spark, d):
    return T(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.size(text.tokens(F.col("text"))).cast("long")).alias("tokens"))


# ---------------------------------------------------------------- ids and stores

_UUID_SQL = """lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12))"""


@query(f"SELECT doc_id, {_UUID_SQL} AS point_id FROM (SELECT doc_id, sha1(unhex('{ids.DNS_NAMESPACE}') || encode(doc_id || '_0')) AS h FROM documents)")
def point_id_uuid5(spark, d):
    return T(spark, d, "documents").select("doc_id", ids.point_id(F.col("doc_id"), F.lit(0)).alias("point_id"))


@query(f"""SELECT point_id, doc_id, text, ingest_ts FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY ingest_ts DESC, text DESC) AS n FROM (
SELECT k AS doc_id, text, ingest_ts, {_UUID_SQL} AS point_id FROM (SELECT doc_id % 100 AS k, text, doc_id AS ingest_ts, sha1(unhex('{ids.DNS_NAMESPACE}') || encode((doc_id % 100) || '_0')) AS h FROM documents))) WHERE n = 1""")
def upsert_dedup(spark, d):
    rows = T(spark, d, "documents").select((F.col("doc_id") % 100).alias("doc_id"), F.lit(0).alias("chunk_index"), "text", F.col("doc_id").alias("ingest_ts"))
    return files.upsert(rows).select("point_id", "doc_id", "text", "ingest_ts")


@query("SELECT doc_id, substr(sha256(encode(strlen(text)::VARCHAR) || encode(text)[1:8192]), 1, 24) AS fingerprint FROM documents")
def doc_fingerprint(spark, d):
    return T(spark, d, "documents").select("doc_id", ids.fingerprint(F.encode("text", "UTF-8")).alias("fingerprint"))


@query("""SELECT doc_id, md5('{"file_path": "' || source || '/' || doc_id || '.html", "mtime": ' || n_chars || ', "parse_method": "auto", "parser": "html"}') AS cache_key FROM documents""")
def cache_key(spark, d):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".html"))
    return T(spark, d, "documents").select("doc_id", ids.cache_key(path, F.col("n_chars"), F.lit("html"), F.lit("auto")).alias("cache_key"))


@query("SELECT count(*) AS entries, round(sum(n_chars) / 1048576, 2) AS size_mb FROM documents")
def cache_stats(spark, d):
    return files.cache_stats(T(spark, d, "documents"), "n_chars")


@query("SELECT doc_id, source FROM documents WHERE source <> 'src0'")
def cache_invalidate(spark, d):
    return files.invalidate(T(spark, d, "documents").withColumn("source_file", F.col("source")), "src0").select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cache_lookup_misses(spark, d):
    return files.cache_misses(T(spark, d, "documents"), T(spark, d, "labels"), "doc_id").select("doc_id")


@query("SELECT doc_id, text, source FROM documents WHERE lang = 'en'")
def payload_filtered_scan(spark, d):
    return T(spark, d, "documents").where("lang = 'en'").select("doc_id", "text", "source")


@query("SELECT label, count(*) AS n_points FROM embeddings GROUP BY label")
def count_points(spark, d):
    return files.assert_dimension(T(spark, d, "embeddings"), "embedding", 64).groupBy("label").agg(F.count(F.lit(1)).alias("n_points"))


# ---------------------------------------------------------------- lexical, dense, fused

_BM25_CTE = f"""
tok AS (SELECT doc_id, unnest({_WORDS.format("text")}) AS term FROM documents),
post AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, len({_WORDS.format("text")})::BIGINT AS dl FROM documents),
st AS MATERIALIZED (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM post GROUP BY term), st),
floor AS MATERIALIZED (SELECT 0.25 * avg(raw) AS least FROM raw),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN least ELSE raw END AS idf FROM raw, floor),
"""
_BM25_RANK = """
sc AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM st)))), 6) AS score
       FROM q JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (doc_id) GROUP BY ALL),
sparse AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM sc WHERE score > 0) WHERE rank <= {k})
"""
_BENCH_Q = f"q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_WORDS.format('text')}) AS term FROM benchmark) GROUP BY ALL),"


@query(f"""WITH t AS (SELECT unnest(list_distinct({_WORDS.format("text")})) AS term FROM documents), c AS (SELECT term, count(*) AS df FROM t GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM c, (SELECT count(*)::DOUBLE AS n FROM documents)),
least AS MATERIALIZED (SELECT 0.25 * avg(raw) AS least FROM raw) SELECT term, df, round(CASE WHEN raw < 0 THEN least ELSE raw END, 6) AS idf FROM raw, least""")
def bm25_index_terms(spark, d):
    return _index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM25_CTE} x AS (SELECT 1) SELECT (SELECT n FROM st)::BIGINT AS n_docs, round((SELECT avgdl FROM st), 6) AS avgdl, (SELECT count(*) FROM post) AS n_postings, (SELECT count(*) FROM idf) AS n_terms")
def bm25_index_stats(spark, d):
    index = _index(spark, d)
    counts = index.terms.agg(F.sum("df").alias("n_postings"), F.count(F.lit(1)).alias("n_terms"))
    return counts.select(F.lit(index.n_docs).cast("long").alias("n_docs"), F.round(F.lit(index.avgdl), 6).alias("avgdl"), "n_postings", "n_terms")


@query(f"WITH {_BM25_CTE} {_BENCH_Q} {_BM25_RANK.format(k=10)} SELECT query_id, doc_id, score, rank FROM sparse")
def bm25_search_topk(spark, d):
    return retrieval.bm25_search(_index(spark, d), T(spark, d, "benchmark"), query="item_id")


_DENSE = """SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM (
SELECT b.item_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
FROM benchmark b JOIN embeddings q ON b.item_id = q.vec_id, embeddings e {where})) WHERE rank <= {k}"""


def _query_vectors(spark, d):
    return T(spark, d, "benchmark").join(T(spark, d, "embeddings"), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), "embedding")


@query(_DENSE.format(k=20, where=""))
def dense_search_topk(spark, d):
    return retrieval.dense_search(T(spark, d, "embeddings"), _query_vectors(spark, d))


@query(_DENSE.format(k=5, where="WHERE e.label = 3"))
def dense_search_filtered(spark, d):
    return retrieval.dense_search(T(spark, d, "embeddings"), _query_vectors(spark, d), k=5, where=F.col("label") == 3)


#: Variants of a benchmark question: itself, and its first six words as a stand-in for an alternative.
_VARIANT_Q = f"""
v AS (SELECT item_id AS query_id, 0 AS variant, text AS query_text FROM benchmark UNION ALL
      SELECT item_id, 1, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:6], ' ') FROM benchmark),
"""


def _variants(spark, d):
    first = F.array_join(F.slice(text.words(F.col("text")), 1, 6), " ")
    return retrieval.query_variants(T(spark, d, "benchmark"), F.array(first), query="item_id")


@query(f"WITH {_VARIANT_Q.strip().rstrip(',')} SELECT query_id, variant, query_text FROM v")
def query_variants(spark, d):
    return _variants(spark, d)


@query(f"WITH {_VARIANT_Q.strip().rstrip(',')} SELECT 'small' AS corpus, query_id, variant FROM v WHERE variant = 0 UNION ALL SELECT 'large', query_id, variant FROM v")
def small_corpus_guard(spark, d):
    v = _variants(spark, d).select("query_id", "variant")
    small = retrieval.small_corpus_guard(v, 20).select(F.lit("small").alias("corpus"), "query_id", "variant")
    return small.unionByName(retrieval.small_corpus_guard(v, 21).select(F.lit("large").alias("corpus"), "query_id", "variant"))


def _fuse_sql(lists: str, item: str = "doc_id", by: str = "query_id") -> str:
    return f"""SELECT {by}, {item}, rrf_score, row_number() OVER (PARTITION BY {by} ORDER BY rrf_score DESC, seen, {item})::INT AS rank FROM (
SELECT {by}, {item}, round(sum(1.0 / (10 + rank)), 9) AS rrf_score, min(list_idx * 1000000 + rank) AS seen FROM ({lists}) GROUP BY {by}, {item})"""


@query(f"WITH {_BM25_CTE} {_BENCH_Q} {_BM25_RANK.format(k=10)}, dense AS ({_DENSE.format(k=20, where='')}) " + _fuse_sql("SELECT query_id, doc_id, rank, 0 AS list_idx FROM dense UNION ALL SELECT query_id, doc_id, rank, 1 FROM sparse"))
def rrf_fuse_two_lists(spark, d):
    dense = dense_search_topk(spark, d).withColumn("list_idx", F.lit(0))
    sparse = bm25_search_topk(spark, d).withColumn("list_idx", F.lit(1))
    return retrieval.rrf(dense.unionByName(sparse), by=["query_id"], item=["doc_id"])


def _hybrid(spark, d):
    """Both variants share their question's vector, for want of an embedding model."""
    v = _variants(spark, d).withColumn("qv", F.col("query_id") * 10 + F.col("variant"))
    index = _index(spark, d)
    sparse = retrieval.bm25_search(index, v, query="qv", text="query_text", k=20)
    vectors = T(spark, d, "embeddings").join(T(spark, d, "documents").select("doc_id"), F.col("vec_id") == F.col("doc_id"))
    asked = v.join(T(spark, d, "embeddings"), F.col("query_id") == F.col("vec_id")).select("qv", "embedding")
    dense = retrieval.dense_search(vectors.select("vec_id", "embedding"), asked, query="qv", k=20)

    def split(x):
        return x.select(F.floor(F.col("query_id") / 10).alias("query_id"), (F.col("query_id") % 10).cast("int").alias("variant"), "doc_id", "rank")

    return retrieval.hybrid_search(split(dense), split(sparse))


_HYBRID_CTE = (
    _VARIANT_Q
    + _BM25_CTE
    + f"q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id * 10 + variant AS query_id, unnest({_WORDS.format('query_text')}) AS term FROM v) GROUP BY ALL),"
    + _BM25_RANK.format(k=20)
    + """, dense AS (SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM (
SELECT v.query_id * 10 + v.variant AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
FROM v JOIN embeddings q ON v.query_id = q.vec_id, embeddings e JOIN documents d ON e.vec_id = d.doc_id)) WHERE rank <= 20),
fd AS ("""
    + _fuse_sql("SELECT query_id // 10 AS query_id, query_id % 10 AS list_idx, doc_id, rank FROM dense")
    + "), fs AS ("
    + _fuse_sql("SELECT query_id // 10 AS query_id, query_id % 10 AS list_idx, doc_id, rank FROM sparse")
    + "), fused AS ("
    + _fuse_sql("SELECT query_id, 0 AS list_idx, doc_id, rank FROM fd UNION ALL SELECT query_id, 1, doc_id, rank FROM fs")
    + ")"
)


@query(f"WITH {_HYBRID_CTE} SELECT query_id, doc_id, rrf_score, rank FROM fused WHERE rank <= 5")
def hybrid_search_topk(spark, d):
    return _hybrid(spark, d).where("rank <= 5")


_OVERLAP = "(SELECT count(*) FROM (SELECT unnest(list_distinct({q})) AS x) WHERE list_contains({t}, x)) * 1.0 / len(list_distinct({q}))".format(q=_WORDS.format("b.text"), t=_WORDS.format("d.text"))


@query(f"""WITH {_HYBRID_CTE} SELECT query_id, doc_id, score, rerank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, doc_id)::INT AS rerank FROM (
SELECT f.query_id, f.doc_id, f.rank, round(len(list_intersect(list_distinct({_WORDS.format("b.text")}), {_WORDS.format("d.text")})) / len(list_distinct({_WORDS.format("b.text")})), 6) AS score
FROM fused f JOIN benchmark b ON f.query_id = b.item_id JOIN documents d USING (doc_id))) WHERE rerank <= 5""")
def rerank_overlap_topk(spark, d):
    c = _hybrid(spark, d).join(T(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q")), "query_id").join(T(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return retrieval.rerank(c, query=F.col("q"), text=F.col("text")).select("query_id", "doc_id", "score", "rerank")


@query(f"WITH {_HYBRID_CTE} SELECT query_id, doc_id, rank AS rerank FROM fused WHERE rank <= 5")
def rerank_fallback(spark, d):
    return retrieval.rerank_fallback(_hybrid(spark, d)).select("query_id", "doc_id", "rerank")


@query(f"""WITH {_HYBRID_CTE} SELECT b.item_id AS query_id, count(f.doc_id) AS n_results,
CASE WHEN count(f.doc_id) = 0 THEN 'refine_query' WHEN max(rrf_score) > 0.15 THEN 'sufficient' ELSE 'evaluate' END AS decision FROM benchmark b LEFT JOIN fused f ON f.query_id = b.item_id GROUP BY b.item_id""")
def retrieval_decision(spark, d):
    top = _hybrid(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("rrf_score").alias("top"))
    out = T(spark, d, "benchmark").select(F.col("item_id").alias("query_id")).join(top, "query_id", "left")
    return out.select("query_id", F.coalesce("n", F.lit(0)).alias("n_results"), retrieval.retrieval_decision(F.col("top"), F.col("n"), threshold=0.15).alias("decision"))


# ---------------------------------------------------------------- routing and grading

#: What a message may open with: words that ask for the conversation itself, and others.
_RECAPS = ("", "recap our conversation: ", "Summarize our talk: ", "what we discussed: ")


@query(f"""SELECT conv_id, turn, category, complexity, CASE WHEN category IN ('chitchat', 'meta') THEN 'simple_response' WHEN category = 'factual' AND complexity <= 2 THEN 'direct_synthesize'
WHEN category = 'summarization' AND regexp_matches(lower(message), 'previous|discussed|conversation|recap|summarize our') THEN 'synthesize' ELSE 'plan' END AS route
FROM (SELECT conv_id, turn, {_CATEGORY_SQL.format("(conv_id + turn)")} AS category, (turn % 5 + 1)::INT AS complexity, {list(_RECAPS)}[(conv_id % 4 + 1)::INT] || text AS message FROM conversations)""")
def route_after_classify(spark, d):
    rows = T(spark, d, "conversations").select("conv_id", "turn", _nth(_CATEGORY_NAMES, F.col("conv_id") + F.col("turn")).alias("category"), (F.col("turn") % 5 + 1).cast("int").alias("complexity"), F.concat(_nth(_RECAPS, F.col("conv_id")), "text").alias("message"))
    return rows.withColumn("route", routing.route_after_classify(F.col("category"), F.col("complexity"), F.col("message"))).drop("message")


_DECISIONS = ("sufficient", "refine_query", "expand_search", "exhausted", "other")


@query(f"""SELECT event_id, CASE WHEN steps >= 6 THEN 'grade' WHEN decision = 'refine_query' AND round < max_rounds THEN 'refine_query' WHEN idx + 1 < total THEN 'next_sub_question' ELSE 'grade' END AS route
FROM (SELECT event_id, {list(_DECISIONS)}[(event_id % 5 + 1)::INT] AS decision, event_id // 5 % 4 AS round, event_id // 20 % 2 * 2 + 1 AS max_rounds, event_id // 40 % 3 AS idx, event_id // 120 % 2 + 1 AS total, user_id % 8 AS steps FROM events)""")
def route_after_retrieve(spark, d):
    part = lambda by, n: F.floor(F.col("event_id") / by) % n
    rows = T(spark, d, "events").select("event_id", _nth(_DECISIONS, F.col("event_id")).alias("decision"), part(5, 4).alias("round"), (part(20, 2) * 2 + 1).alias("max_rounds"), part(40, 3).alias("idx"), (part(120, 2) + 1).alias("total"), (F.col("user_id") % 8).alias("steps"))
    return rows.select("event_id", routing.route_after_retrieve(*[F.col(c) for c in rows.columns[1:]]).alias("route"))


@query("SELECT conv_id, turn, CASE WHEN turn + 1 < total THEN 'retrieve' ELSE 'grade' END AS route FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)")
def route_after_next(spark, d):
    """Each turn as a sub-question of its conversation."""
    turns = T(spark, d, "conversations").select("conv_id", "turn")
    total = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total"))
    return turns.join(total, "conv_id").select("conv_id", "turn", routing.route_after_next(F.col("turn") + 1, F.col("total")).alias("route"))


_ROUTER_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in routing.INTENTS) + " ELSE 'factual' END"


@query(f"SELECT conv_id, turn, {_ROUTER_SQL} AS category FROM conversations WHERE role = 'user'")
def router_rules(spark, d):
    return T(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", routing.classify(F.col("text")).alias("category"))


@query("SELECT event_id, CASE WHEN v >= 0 AND v <= 1 THEN v ELSE 0.7 END AS confidence, CASE WHEN v >= 0 AND v <= 1 THEN v ELSE 0.7 END < 0.7 AS low_confidence FROM (SELECT event_id, value / 10 AS v FROM events)")
def router_validate(spark, d):
    v = routing.valid_confidence(F.col("value") / 10)
    return T(spark, d, "events").select("event_id", v.alias("confidence"), (v < 0.7).alias("low_confidence"))


@query(r"""WITH w AS (SELECT item_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w, CASE WHEN item_id % 2 = 0 THEN 'factual' ELSE 'analytical' END AS category FROM benchmark),
s AS (SELECT item_id, CASE WHEN category = 'factual' OR len(w) < 2 THEN [text] ELSE [array_to_string(w[1:ceil(len(w) / 2)::INT], ' '), array_to_string(w[ceil(len(w) / 2)::INT + 1:], ' ')] END AS s FROM w)
SELECT item_id, i::INT AS idx, s[i + 1] AS sub_question FROM (SELECT item_id, s, unnest(range(0, len(s))) AS i FROM s)""")
def planner_split(spark, d):
    category = F.when(F.col("item_id") % 2 == 0, "factual").otherwise("analytical")
    return T(spark, d, "benchmark").select("item_id", F.posexplode(routing.plan(F.col("text"), category)).alias("idx", "sub_question"))


_GRADED = "documents JOIN labels USING (doc_id)"


def _graded(spark, d):
    return T(spark, d, "documents").join(T(spark, d, "labels"), "doc_id")


@query(f"SELECT doc_id, source, quality FROM {_GRADED} WHERE quality = 1")
def grade_filter(spark, d):
    return routing.split_graded(_graded(spark, d), F.col("quality") == 1, reason=F.lit(None).cast("string"), section="lang")[0].select("doc_id", "source", "quality")


@query(f"SELECT doc_id, source, lang AS section, 'quality ' || quality AS reason, substr(text, 1, 100) AS preview FROM {_GRADED} WHERE quality <> 1")
def grade_rejected(spark, d):
    reason = F.concat(F.lit("quality "), F.col("quality").cast("string"))
    return routing.split_graded(_graded(spark, d), F.col("quality") == 1, reason=reason, section="lang")[1].select("doc_id", "source", "section", "reason", "preview")


@query(f"SELECT source, round(avg(quality), 6) AS relevance_ratio, count(*) AS total FROM {_GRADED} GROUP BY source")
def grade_relevance(spark, d):
    return routing.relevance(_graded(spark, d), F.col("quality") == 1, by="source")


#: Of a question's halves as sub-questions: what the answers hold of them, by the item's number.
@query(r"""WITH w AS (SELECT item_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT item_id, text, CASE WHEN item_id % 7 = 6 THEN []::VARCHAR[] ELSE [array_to_string(w[1:4], ' '), array_to_string(w[5:], ' ')] END AS subs, array_to_string(w[1:4], ' ') AS one FROM w),
a AS (SELECT item_id, subs, (item_id % 3)::INT AS n, CASE item_id % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [upper(one)] WHEN 2 THEN ['xx ' || lower(text) || ' xx'] ELSE ['nothing of it', one || '!'] END AS ans FROM s)
SELECT item_id, CASE WHEN len(subs) > 0 THEN round(len(list_filter(subs, lambda q: len(list_filter(ans, lambda a: contains(lower(q), lower(a)) OR contains(lower(a), lower(q)))) > 0)) / len(subs), 6)
WHEN n > 0 THEN 1.0 ELSE 0.0 END AS coverage FROM a""")
def grade_coverage(spark, d):
    w = text.words(F.col("text"))
    one, none = F.array_join(F.slice(w, 1, 4), " "), F.array().cast("array<string>")
    subs = F.when(F.col("item_id") % 7 == 6, none).otherwise(F.array(one, F.array_join(F.slice(w, 5, 100_000), " ")))
    said = F.when(F.col("item_id") % 4 == 0, none).when(F.col("item_id") % 4 == 1, F.array(F.upper(one))).when(F.col("item_id") % 4 == 2, F.array(F.concat(F.lit("xx "), F.lower("text"), F.lit(" xx"))))
    said = said.otherwise(F.array(F.lit("nothing of it"), F.concat(one, F.lit("!"))))
    rows = T(spark, d, "benchmark").select("item_id", subs.alias("subs"), said.alias("ans"), (F.col("item_id") % 3).alias("n"))
    return rows.select("item_id", F.round(routing.coverage(F.col("subs"), F.col("ans"), F.col("n")), 6).alias("coverage"))


@query(f"""SELECT source, category, n, target, CASE WHEN n = 0 THEN 'empty' WHEN n >= target THEN 'sufficient' WHEN category IN ('analytical', 'procedural', 'comparative') THEN 'unknown'
WHEN n >= target * 0.5 THEN 'adequate' ELSE 'insufficient' END AS level
FROM (SELECT source, c AS category, sum(quality)::INT % 9 AS n, (3 + min(doc_id) % 5)::INT AS target FROM (SELECT source, quality, doc_id, {_CATEGORY_SQL.format("doc_id")} AS c FROM documents JOIN labels USING (doc_id)) GROUP BY source, c)""")
def grade_completeness(spark, d):
    """Good documents of each source and category as the chunks that were accepted."""
    rows = _graded(spark, d).withColumn("category", _nth(_CATEGORY_NAMES, F.col("doc_id"))).groupBy("source", "category")
    rows = rows.agg((F.sum("quality") % 9).cast("int").alias("n"), (3 + F.min("doc_id") % 5).cast("int").alias("target"))
    return rows.withColumn("level", routing.completeness(F.col("n"), F.col("target"), F.col("category")))


#: Weights of relevance, coverage and completeness, and the levels' scores, typed here so that a wrong one in the engine shows.
_SCORE_SQL = """(CASE WHEN category IN ('factual', 'summarization') THEN 0.5 WHEN category IN ('comparative', 'analytical') THEN 0.3 WHEN category = 'procedural' THEN 0.2 ELSE 0.4 END)::DOUBLE * relevance
+ (CASE WHEN category IN ('factual', 'summarization') THEN 0.2 WHEN category IN ('comparative', 'analytical') THEN 0.4 ELSE 0.3 END)::DOUBLE * covered
+ (CASE WHEN category = 'procedural' THEN 0.5 ELSE 0.3 END)::DOUBLE * (CASE level WHEN 'sufficient' THEN 0.9 WHEN 'adequate' THEN 0.7 WHEN 'insufficient' THEN 0.3 WHEN 'empty' THEN 0.0 ELSE 0.5 END)::DOUBLE"""
_LEVEL_NAMES = ("sufficient", "adequate", "insufficient", "empty", "unknown")


@query(f"""SELECT event_id, category, level, round({_SCORE_SQL}, 6) AS score
FROM (SELECT event_id, {_CATEGORY_SQL.format("event_id")} AS category, {list(_LEVEL_NAMES)}[(event_id // 8 % 5 + 1)::INT] AS level, (event_id // 40 % 5) * 0.25::DOUBLE AS relevance, (user_id % 4) / 4::DOUBLE AS covered FROM events)""")
def grade_overall(spark, d):
    rows = T(spark, d, "events").select("event_id", _nth(_CATEGORY_NAMES, F.col("event_id")).alias("category"), _nth(_LEVEL_NAMES, F.floor(F.col("event_id") / 8)).alias("level"), (F.floor(F.col("event_id") / 40) % 5 * 0.25).alias("relevance"), (F.col("user_id") % 4 / 4).alias("covered"))
    return rows.select("event_id", "category", "level", routing.overall_score(F.col("relevance"), F.col("covered"), F.col("level"), F.col("category"), 6).alias("score"))


@query(f"WITH {_HYBRID_CTE} SELECT query_id, 0 AS round, doc_id FROM fused WHERE rank <= 5 UNION ALL SELECT query_id, 1, doc_id FROM fused WHERE rank <= 3")
def state_accumulate(spark, d):
    h = _hybrid(spark, d)
    return routing.accumulated([h.where(F.col("rank") <= k).select("query_id", "doc_id") for k in (5, 3)])


# ---------------------------------------------------------------- context and citations

_PART_SQL = "'[Source: ' || coalesce(source, 'unknown') || ' | Section: ' || coalesce(lang, 'unknown') || ']' || chr(10) || replace(coalesce(text, ''), '</retrieved_context>', '&lt;/retrieved_context&gt;')"
_SEP_SQL = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


def _parts(spark, d):
    return T(spark, d, "documents").select("doc_id", "source", F.col("lang").alias("section"), "text").withColumn("part", context.context_part(F.col("source"), F.col("section"), F.col("text")))


@query(f"""SELECT source, count(*) AS n_chunks, '<retrieved_context>' || chr(10) || string_agg(part, {_SEP_SQL} ORDER BY doc_id) || chr(10) || '</retrieved_context>' AS context FROM (
SELECT source, doc_id, part, sum(length(part) + 7) OVER (PARTITION BY source ORDER BY doc_id) - 7 AS used FROM (SELECT source, doc_id, {_PART_SQL} AS part FROM documents)) WHERE used <= 20000 GROUP BY source""")
def context_budget(spark, d):
    return context.build_context(_parts(spark, d), by="source", order="doc_id", budget=20_000)


@query(f"SELECT lang, md5(substr(string_agg({_PART_SQL}, {_SEP_SQL} ORDER BY doc_id), 1, 100000)) AS context_md5 FROM documents GROUP BY lang")
def context_legacy(spark, d):
    leading = context.leading_parts(_parts(spark, d).select("doc_id", "section", "part"), by="section", order="doc_id")
    rows = leading.groupBy(F.col("section").alias("lang")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "part"))), lambda x: x["part"]).alias("parts"))
    return rows.select("lang", F.md5(context.legacy_context(F.col("parts"))).alias("context_md5"))


@query(f"""SELECT conv_id, turn, CASE WHEN category IN ('chitchat', 'meta') THEN NULL WHEN n = 0 THEN 'I could not find sufficient information in the documents to answer your question. Please try rephrasing or providing more context.'
WHEN category = 'comparative' AND n < 2 THEN 'I need more information to make a meaningful comparison. Could you specify which aspects you''d like me to compare?' END AS message
FROM (SELECT conv_id, turn, {_CATEGORY_SQL.format("conv_id")} AS category, turn % 3 AS n FROM conversations)""")
def context_guard(spark, d):
    return T(spark, d, "conversations").select("conv_id", "turn", context.guard(F.col("turn") % 3, _nth(_CATEGORY_NAMES, F.col("conv_id"))).alias("message"))


@query("""SELECT lang, chr(10) || chr(10) || '---' || chr(10) || '**Sources Used:**' || chr(10) || string_agg('- ' || label, chr(10) ORDER BY o, label) AS footer FROM (
SELECT lang, source || ' — ' || lang AS label, min(doc_id) AS o FROM documents GROUP BY lang, source) GROUP BY lang""")
def citation_footer(spark, d):
    return context.sources_footer(_parts(spark, d).withColumn("lang", F.col("section")), by="lang", order="doc_id")


@query(r"SELECT doc_id, regexp_matches(text, '\[.+?\]') AS cited FROM documents")
def citation_check(spark, d):
    return T(spark, d, "documents").select("doc_id", text.has_citation(F.col("text")).alias("cited"))


@query("SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents GROUP BY lang")
def distinct_sources(spark, d):
    return context.distinct_sources(T(spark, d, "documents"), "lang").select("lang", F.array_join("sources", ",").alias("sources"))


def _prompt_sql() -> str:
    def said(t: str) -> str:
        return "'" + t.replace("'", "''") + "'"

    category = "CASE item_id % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(routing.CATEGORIES)) + " END"
    task = "CASE category " + " ".join(f"WHEN '{k}' THEN {said(v)}" for k, v in context.TASKS.items()) + " END"
    body = f"{task} || chr(10) || chr(10) || 'Question: ' || text"
    wrapped = "chr(10) || chr(10) || '<retrieved_context>' || chr(10) || 'evidence' || chr(10) || '</retrieved_context>'"
    return f"SELECT item_id, category, CASE WHEN category IN ('chitchat', 'meta') THEN {body} ELSE {said(context.FIREWALL)} || {body} || {wrapped} END AS prompt FROM (SELECT *, {category} AS category FROM benchmark)"


@query(_prompt_sql())
def synthesis_prompts(spark, d):
    rows = T(spark, d, "benchmark").withColumn("category", F.element_at(F.array(*map(F.lit, routing.CATEGORIES)), (F.col("item_id") % 8 + 1).cast("int")))
    return rows.select("item_id", "category", context.prompt(F.col("category"), F.col("text"), context.wrap(F.lit("evidence"))).alias("prompt"))


# ---------------------------------------------------------------- memory


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def session_recent_turns(spark, d):
    return memory.recent_turns(T(spark, d, "conversations"), 3)


@query("SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || coalesce(text, ''), chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def session_transcript(spark, d):
    return memory.transcript(T(spark, d, "conversations"))


@query("SELECT conv_id, count(*) AS n_turns, count(*) > 5 AS overflow FROM conversations GROUP BY conv_id")
def session_overflow(spark, d):
    return memory.overflowing(T(spark, d, "conversations"), 5)


@query("SELECT conv_id, turn, CASE WHEN prior > 0 THEN text || ' (in context)' ELSE text END AS effective_query, prior > 0 AS was_rewritten FROM (SELECT *, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM conversations) WHERE role = 'user'")
def rewrite_guard(spark, d):
    from pyspark.sql import Window

    prior = F.count(F.lit(1)).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    rows = T(spark, d, "conversations").withColumn("prior", prior).where("role = 'user'")
    said, did = memory.rewrite_query(F.col("text"), F.col("prior"), F.concat("text", F.lit(" (in context)")))
    return rows.select("conv_id", "turn", said.alias("effective_query"), did.alias("was_rewritten"))


@query("""SELECT user_id, recency, '[' || strftime(ts, '%Y-%m-%d %H:%M') || ' | Topics: ' || CASE WHEN event_type = 'error' THEN 'general' ELSE event_type || ', event' END || '] ' || props AS line
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS recency FROM events) WHERE recency <= 5""")
def episodic_recent(spark, d):
    rows = memory.recent_episodes(T(spark, d, "events"), user="user_id", created="ts", tie="event_id")
    tags = F.when(F.col("event_type") == "error", F.array().cast("array<string>")).otherwise(F.array("event_type", F.lit("event")))
    return rows.select("user_id", "recency", memory.episode_line(F.col("ts"), tags, F.col("props")).alias("line"))


# ---------------------------------------------------------------- summaries


@query("SELECT sum(ok)::BIGINT AS successful, count(*) - sum(ok)::BIGINT AS failed, count(*) AS total, sum(ok)::BIGINT / count(*) * 100 AS success_rate FROM (SELECT CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS ok FROM documents)")
def batch_summary(spark, d):
    return files.batch_summary(T(spark, d, "documents").withColumn("ok", F.col("n_chars") > 1000))


@query("SELECT event_type, bool_and(value < 99) AS healthy, CASE WHEN bool_and(value < 99) THEN 'ok' ELSE 'degraded' END AS status FROM events GROUP BY event_type")
def health_rollup(spark, d):
    return routing.health(T(spark, d, "events"), F.col("value") < 99, by="event_type")


def _blocks(spark, d):
    kind = F.when(F.col("turn") % 3 == 0, "text").when(F.col("turn") % 3 == 1, "image").otherwise("table")
    return T(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("position"), kind.alias("type"), "text")


@query("SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE turn % 3 = 0 AND trim(text) <> '' GROUP BY conv_id")
def modality_split(spark, d):
    return parsing.split_modalities(_blocks(spark, d))[0]


@query("SELECT CASE WHEN turn % 3 = 1 THEN 'image' ELSE 'table' END AS type, count(*) AS n, sum(turn)::BIGINT AS places FROM conversations WHERE turn % 3 <> 0 GROUP BY 1")
def block_type_counts(spark, d):
    return parsing.split_modalities(_blocks(spark, d))[1].groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("content_list_index").alias("places"))


# ---------------------------------------------------------------- markup, layout, whole plans


#: Nodes of pages whose blocks are ``h1`` and ``p``: the text up to the end of each, without tags.
_NODES_SQL = r"""parts AS (SELECT page_id, string_split_regex(regexp_replace(html, '(?is)<head>.*?</head>|<nav>.*?</nav>|<footer>.*?</footer>|<script>.*?</script>|<style>.*?</style>|<!--.*?-->', '', 'g'), '<(h1|p)>')[2:] AS p FROM pages),
cut AS (SELECT page_id, unnest(p) AS raw, generate_subscripts(p, 1) AS place FROM parts),
said AS (SELECT page_id, place, regexp_replace(replace(regexp_extract(raw, '(?s)^(.*?)(</h1>|</p>|</article>|$)', 1), '<br>', ' '), '<[^>]*>', '', 'g') AS t FROM cut),
texts AS (SELECT page_id, place, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM said),
nodes AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY place) - 1)::INT AS position, CASE WHEN place = 1 THEN 'heading' ELSE 'block' END AS type,
CASE WHEN place = 1 THEN 1 END AS level, text, CASE WHEN place = 1 THEN '' ELSE max(text) FILTER (place = 1) OVER (PARTITION BY page_id) END AS breadcrumb
FROM texts WHERE place = 1 OR length(text) >= 20)"""
_PAGE_SQL = f"WITH {_NODES_SQL} SELECT page_id, string_agg(text, chr(10) || chr(10) ORDER BY position) AS text FROM nodes GROUP BY page_id"


@query(f"WITH {_NODES_SQL} SELECT page_id, position, type, level, text, breadcrumb FROM nodes")
def html_nodes(spark, d):
    return parsing.html_nodes(store.spread(T(spark, d, "pages"), "page_id"))


@query(_PAGE_SQL)
def html_page_text(spark, d):
    return parsing.page_text(parsing.html_nodes(T(spark, d, "pages")))


_TREE = {"body": {"children": [{"$ref": "#/texts/0"}, {"$ref": "#/groups/0"}, {"$ref": "#/tables/0"}, {"$ref": "#/broken/9"}]},
         "groups": [{"children": [{"$ref": "#/texts/1"}, {"$ref": "#/pictures/0"}]}],
         "texts": [{"label": "text", "orig": "Hello World", "prov": [{"page_no": 1}]}, {"label": "formula", "orig": "a+b", "prov": [{"page_no": 2}]}],
         "pictures": [{"prov": []}], "tables": [{"data": {"grid": []}, "prov": [{"page_no": 3}]}]}


@query("""SELECT page_id AS doc_id, position, type, text, page_idx FROM pages,
(VALUES (0, 'text', 'Hello World', 1), (1, 'equation', 'a+b', 2), (2, 'image', NULL, 0), (3, 'table', '{"grid": []}', 3)) t(position, type, text, page_idx)""")
def layout_block_tree(spark, d):
    return parsing.layout_table(T(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit(json.dumps(_TREE)).alias("tree")))


#: UUIDv5 of a column ``name``, from the SHA-1 of the namespace and it.
_UUID5 = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""
_SHA1 = f"sha1(unhex('{ids.DNS_NAMESPACE}') || encode({{name}}))"


@query(f"""SELECT {_UUID5} AS point_id, doc_id, chunk_index, text, source_file, fingerprint FROM (
SELECT doc_id::VARCHAR AS doc_id, chunk_index, chunk_text AS text, source AS source_file, {_SHA1.format(name="doc_id || '_' || chunk_index")} AS h,
substr(sha256(encode(strlen(full_text)::VARCHAR) || encode(full_text)[1:8192]), 1, 24) AS fingerprint
FROM ({_CHUNKS.format(step=448, size=512)}) JOIN (SELECT doc_id, source, text AS full_text FROM documents) USING (doc_id))""")
def ingest_chunks(spark, d):
    from quarryline.plans.answer import ingest

    return ingest(T(spark, d, "documents"))


#: Openings that make the benchmark's items questions of several categories.
_OPENINGS = ("compare ", "what is ", "steps to ", "hello ", "why did ")


@query()
def answer_questions(spark, d):
    from quarryline.plans.answer import answer

    chunks = chunking.fixed_windows(T(spark, d, "documents")).select((F.col("doc_id") * 1000 + F.col("chunk_index")).alias("chunk_id"), F.col("chunk_text").alias("text"), "source", F.col("lang").alias("section"))
    chunks = store.written(chunks, store.scratch_path(spark, "chunks"))
    opening = F.element_at(F.array(*map(F.lit, _OPENINGS)), (F.col("item_id") % len(_OPENINGS) + 1).cast("int"))
    asked = T(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.concat(opening, "text").alias("question"))
    return answer(asked, chunks, retrieval.build_index(chunks, key="chunk_id", inverted=False))


def _stream_dir(spark) -> str:
    return store.scratch_path(spark, "stream")


@query(f"""SELECT doc_id, chunk_index, text, ingest_ts, {_UUID5} AS point_id FROM (SELECT *, {_SHA1.format(name="doc_id || '_' || chunk_index")} AS h FROM (
SELECT doc_id % 100 AS doc_id, 0 AS chunk_index, text, doc_id AS ingest_ts, row_number() OVER (PARTITION BY doc_id % 100 ORDER BY doc_id DESC, text DESC) AS n FROM documents) WHERE n = 1)""")
def stream_ingest_upsert(spark, d):
    at = _stream_dir(spark)
    docs = T(spark, d, "documents")
    rows = spark.readStream.schema(docs.schema).parquet(f"{d}/documents.parque[t]").select((F.col("doc_id") % 100).alias("doc_id"), F.lit(0).alias("chunk_index"), "text", F.col("doc_id").alias("ingest_ts"))
    streams.ingest_stream(rows, f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return streams.read_ingested(spark, f"{at}/table")


#: A session lives on until two hours after its last turn; the watermark is ten minutes behind the last turn of all.
@query("""SELECT conv_id::VARCHAR AS session_id, count(*) AS n_turns, array_to_string(list(coalesce(role, '') || ': ' || coalesce(text, '') ORDER BY turn)[-10:], chr(10)) AS recent,
max(conv_id * 60 + turn * 10) + 7200 <= (SELECT max(conv_id * 60 + turn * 10) - 600 FROM conversations) AS expired FROM conversations GROUP BY conv_id""")
def stream_session_ttl(spark, d):
    """What each session last gave: the turns it had, and whether it has ended."""
    at = _stream_dir(spark)
    turns = T(spark, d, "conversations")
    start = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 60 + F.col("turn") * 10)
    rows = spark.readStream.schema(turns.schema).parquet(f"{d}/conversations.parque[t]").select(F.col("conv_id").cast("string").alias("session_id"), "turn", "role", "text", start.alias("ts"))
    out = streams.session_stream(rows)

    def put(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")

    out.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{at}/out").groupBy("session_id").agg(F.max_by(F.struct("n_turns", "recent", "expired"), F.struct("epoch", "n_turns", "expired")).alias("r"))
    return last.select("session_id", "r.n_turns", F.array_join("r.recent", "\n").alias("recent"), "r.expired")


# ---------------------------------------------------------------- model seam, stores, histories


def _turn_pairs(spark, d):
    return T(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("user"), F.when(F.col("role") != "user", F.col("text")).alias("assistant"))


_HISTORY = """SELECT conv_id, any_value(total) AS n_turns, string_agg(place || '. User: ' || CASE WHEN role = 'user' THEN coalesce(text, '') ELSE '' END || chr(10) || '   Assistant: ' || CASE WHEN role = 'user' THEN '' ELSE coalesce(text, '') END, chr(10) ORDER BY turn) AS history
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations) WHERE n <= 5) GROUP BY conv_id"""


@query(_HISTORY)
def history_lines(spark, d):
    return context.history_lines(_turn_pairs(spark, d), by="conv_id", turn="turn", user="user", assistant="assistant")


@query(f"""SELECT conv_id, chr(10) || 'Previous conversation turns:' || chr(10) || history || chr(10) || chr(10) || 'Conversation analysis:' || chr(10) || '- Total turns: ' || n_turns || chr(10)
|| '- Turn depth for context: ' || least(n_turns, 5) || chr(10) || '- This appears to be a follow-up question that may reference previous context.' || chr(10) AS told FROM ({_HISTORY})""")
def router_history(spark, d):
    return history_lines(spark, d).select("conv_id", context.router_history(F.col("history"), F.col("n_turns")).alias("told"))


def _attempts(spark, d):
    return T(spark, d, "conversations").select("conv_id", F.col("turn").alias("step"), F.col("text").alias("query"), F.concat(F.lit("as "), "role").alias("reasoning"), F.when(F.col("turn") % 2 == 0, "sufficient").otherwise("refine_query").alias("decision"))


_ATTEMPTS = """SELECT conv_id, string_agg('Round ' || place || ': query=' || chr(39) || text || chr(39) || ' -> as ' || role, chr(10) ORDER BY turn) AS history
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 2) GROUP BY conv_id"""


@query(f"SELECT conv_id, 'Original question: q' || chr(10) || chr(10) || 'Previous retrieval attempts:' || chr(10) || history || chr(10) || chr(10) || 'Give a better search query that avoids what didn''t work, and nothing else.' AS prompt FROM ({_ATTEMPTS})")
def refinement_prompts(spark, d):
    return context.attempts(_attempts(spark, d), by="conv_id", step="step").select("conv_id", context.refinement_prompt(F.lit("q"), F.col("history")).alias("prompt"))


@query("SELECT conv_id, CASE WHEN max(turn) % 2 = 0 THEN 'sufficient' ELSE 'refine_query' END AS decision FROM conversations GROUP BY conv_id")
def last_decision(spark, d):
    return routing.last_decision(_attempts(spark, d), by="conv_id")


@query("""SELECT conv_id, 'Original question: q' || chr(10) || 'Search query used: s' || chr(10) || chr(10) || 'Retrieved chunks:' || chr(10) || string_agg('Chunk ' || n || ': ' || substr(text, 1, 300) || '...', chr(10) ORDER BY turn)
|| chr(10) || chr(10) || 'Answer in JSON with scores, decision (sufficient, refine_query, expand_search or exhausted), reasoning and refined_query.' AS prompt
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations) GROUP BY conv_id""")
def evaluation_prompts(spark, d):
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return T(spark, d, "conversations").groupBy("conv_id").agg(texts.alias("texts")).select("conv_id", context.evaluation_prompt(F.lit("q"), F.lit("s"), F.col("texts")).alias("prompt"))


@query("""SELECT conv_id AS session_id, any_value('u' || conv_id % 7) AS user_id, substr(string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || coalesce(text, ''), chr(10) ORDER BY turn), 1, 200) AS summary,
count(*)::INT AS turn_count, max(turn) AS created_at FROM conversations GROUP BY conv_id""")
def compress_sessions(spark, d):
    turns = T(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.concat(F.lit("u"), (F.col("conv_id") % 7).cast("string")).alias("user_id"), "turn", "role", "text", F.col("turn").alias("ts"))
    return memory.compress_sessions(turns).drop("topic_tags")


@query("SELECT user_id, recency, '[' || strftime(ts, '%Y-%m-%d %H:%M') || ' | Topics: ' || event_type || '] ' || props AS line FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS recency FROM events) WHERE recency <= 5")
def episodes_saved_and_loaded(spark, d):
    events = T(spark, d, "events")
    folder = store.scratch_path(spark, "episodes")
    memory.save_episodes(events.select("user_id", F.col("event_id").alias("session_id"), F.col("props").alias("summary"), F.array("event_type").alias("topic_tags"), F.lit(1).alias("turn_count"), F.col("ts").alias("created_at")), folder)
    return memory.load_episodes(spark, folder, events.select("user_id").distinct())


@query("SELECT doc_id, md5(text) AS parsed_md5 FROM documents WHERE source <> 'src1' AND text IS NOT NULL")
def parse_cache_roundtrip(spark, d):
    cache = store.ParseCache(spark, store.scratch_path(spark, "cache"))
    docs = T(spark, d, "documents").where("text IS NOT NULL")
    rows = docs.select(F.col("doc_id").cast("string").alias("cache_key"), F.col("source").alias("source_file"), F.to_json(F.struct("text")).alias("parsed"))
    corrupt = rows.limit(1).select(F.lit("corrupt").alias("cache_key"), "source_file", F.lit("{").alias("parsed"))  # one row that must evict itself
    cache.store(rows.unionByName(corrupt))
    cache.invalidate("src1")
    kept = cache.get(rows.select("cache_key")).where("parsed IS NOT NULL")
    return kept.select(F.col("cache_key").cast("long").alias("doc_id"), F.md5(F.get_json_object("parsed", "$.text")).alias("parsed_md5"))


@query("SELECT doc_id, chunk_index, md5(chunk_text) AS text_md5, 64 AS width, 'hashed' AS model_name FROM (" + _CHUNKS.format(step=448, size=512) + ")")
def embed_chunks(spark, d):
    chunks = chunking.fixed_windows(T(spark, d, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", F.col("chunk_text").alias("text"))
    out = models.embed_documents(chunks)
    return out.select("doc_id", "chunk_index", F.md5("text").alias("text_md5"), F.size("vector").alias("width"), "model_name")


@query("SELECT doc_id, sum(n)::BIGINT AS n_chunks FROM (SELECT doc_id, count(*) AS n FROM (" + _CHUNKS.format(step=448, size=512) + ") GROUP BY doc_id) GROUP BY doc_id")
def ingest_outputs(spark, d):
    """Two ingests into one store: the second replaces its own documents' parts and leaves the others."""
    chunks = chunking.fixed_windows(T(spark, d, "documents").select("doc_id", "text"))
    folder = store.scratch_path(spark, "ingest")
    store.dump_ingest(chunks, None, folder)
    store.dump_ingest(chunks.where("doc_id % 3 = 0"), None, folder)
    return spark.read.parquet(f"{folder}/chunks").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))


#: Answers of a router by the item's number: fenced, out of bounds, without a strategy, no JSON, unsure, and none.
_ROUTER_ANSWERS = (
    '```json\n{"primary_category": "procedural", "confidence_score": 0.9, "retrieval_strategy": {"chunking_strategy": "small", "target_chunks": 4}, "complexity_level": 3}\n```',
    '{"primary_category": "chitchat", "confidence_score": 1.7, "retrieval_strategy": {}, "requires_citation": true}',
    '{"primary_category": "analytical", "confidence_score": 0.4}',
    "no json",
    '{"primary_category": "comparative", "confidence_score": 0.3, "retrieval_strategy": {"max_retrieval_depth": 4}}',
)


@query("""SELECT item_id, t.* EXCLUDE (id) FROM benchmark JOIN (VALUES (0, 'procedural', 0.9::DOUBLE, false, '', 'large', 3, 4, 3, true, true), (1, 'chitchat', 0.7::DOUBLE, false, '', 'medium', 2, 0, 2, false, false),
(2, 'factual', 0.6::DOUBLE, true, 'factual,analytical', 'medium', 2, 5, 2, true, true), (3, 'factual', 0.6::DOUBLE, false, '', 'medium', 2, 5, 2, true, true),
(4, 'comparative', 0.3::DOUBLE, true, 'factual,analytical', 'medium', 4, 5, 2, true, true))
t(id, category, confidence, requires_confirmation, fallback_categories, chunking_strategy, max_retrieval_depth, target_chunks, complexity, requires_citation, requires_source_attribution) ON t.id = item_id % 5""")
def router_validation(spark, d):
    """A scripted router's answers to the benchmark's questions."""
    df = T(spark, d, "benchmark").select("item_id", routing.validated(_nth(_ROUTER_ANSWERS, F.col("item_id"))).alias("r"))
    return df.select("item_id", "r.*").withColumn("fallback_categories", F.array_join("fallback_categories", ","))


@query("""SELECT doc_id, t.* EXCLUDE (id) FROM labels JOIN (VALUES (0, true, 0.8::DOUBLE, 'sufficient', false), (1, false, 0.0::DOUBLE, 'unknown', false), (2, false, 0.0::DOUBLE, 'insufficient', true)) t(id, relevant, score, level, missing_critical_info) ON t.id = doc_id % 3""")
def grader_defaults(spark, d):
    """A scripted grader's answers on the labelled documents: whole, unreadable, and of wrong types."""
    grades = ('{"relevant": true, "score": 0.8, "reason": "x"}', "?", '{"score": "high"}')
    deep = ('{"sufficient": true, "missing_critical_info": false}', "?", '{"sufficient": false}')
    df = T(spark, d, "labels").select("doc_id", routing.chunk_grade(_nth(grades, F.col("doc_id"))).alias("g"), routing.deep_completeness(_nth(deep, F.col("doc_id"))).alias("d"))
    return df.select("doc_id", "g.relevant", "g.score", "d.level", "d.missing_critical_info")


@query("SELECT source, round(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) / count(*), 6) AS coverage FROM documents JOIN labels USING (doc_id) GROUP BY source")
def coverage_by_counts(spark, d):
    per = _graded(spark, d).groupBy("source").agg(F.sum((F.col("quality") == 1).cast("int")).alias("found"), F.count(F.lit(1)).alias("total"))
    return per.select("source", F.round(routing.covered_with_fallback(F.col("found"), F.col("total")), 6).alias("coverage"))


@query("SELECT count(*) AS calls, sum(turn)::BIGINT AS prompt_tokens, sum(length(text))::BIGINT AS completion_tokens, sum(turn + length(text))::BIGINT AS total_tokens FROM conversations")
def model_call_totals(spark, d):
    return models.token_totals(T(spark, d, "conversations").select(F.col("turn").alias("prompt_tokens"), F.length("text").cast("long").alias("completion_tokens")))


#: Lines become pages, some of them beyond the range of twenty, each range followed by a line feed.
@query("""WITH p AS (SELECT 'd' || doc_id AS path, string_split(replace(replace(text, chr(12), ' '), chr(10), chr(12)), chr(12)) AS pages FROM documents)
SELECT path, array_to_string(list_transform(range(0, len(pages), 20), lambda i: array_to_string(pages[i + 1:i + 20], chr(12)) || chr(10)), '') AS text, ((len(pages) + 19) // 20)::INT AS n_ranges FROM p""")
def parse_files_by_page(spark, d):
    paged = F.translate(F.replace("text", F.lit("\f"), F.lit(" ")), "\n", "\f")
    docs = T(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.encode(paged, "UTF-8").alias("content"))
    counted = T(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.size(F.split(paged, "\f")).alias("n"))
    ranges = counted.select("path", F.size(files.page_ranges(F.col("n"))).alias("n_ranges"))
    return parsers.parse_files(docs).select("path", "text").join(ranges, "path")


_CUT_TAGS = "html|body|main|article|section|div|p|ul|ol|li|dl|dt|dd|table|tr|td|th|blockquote|pre|nav|header|footer|aside|form"
_GONE_TAGS = "|".join(f"<{t}\\b.*?</{t}>" for t in ("head", "script", "style", "noscript", "nav", "header", "footer", "aside", "form"))
_N_WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> ''))"
_BARE = r"regexp_replace(regexp_replace({}, '(?i)<br\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')"
#: Pieces of a page between block tags, weighed by words and links with their neighbours.
_CONTENT_SQL = rf"""clean AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|{_GONE_TAGS}', ' ', 'g'), '(?i)<h[1-6]\b[^>]*>', '<p>' || chr(1), 'g'), '(?i)</h[1-6]>', '</p>', 'g') AS h FROM pages),
cut AS (SELECT page_id, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS position FROM (SELECT page_id, regexp_split_to_array(h, '(?i)</?(?:{_CUT_TAGS})\b[^>]*>') AS p FROM clean)),
raws AS (SELECT page_id, position, starts_with(piece, chr(1)) AS heading, replace({_BARE.format("piece")}, chr(1), '') AS raw, array_to_string(regexp_extract_all(piece, '(?is)<a\b[^>]*>(.*?)</a>', 1), ' ') AS links FROM cut),
counted AS (SELECT *, {_N_WORDS.format("raw")} AS words, {_N_WORDS.format(_BARE.format("links"))} AS linked FROM raws WHERE {_N_WORDS.format("raw")} > 0),
scored AS (SELECT *, coalesce(lag(words - 3 * least(linked, words)) OVER o, 0) + 2 * (words - 3 * least(linked, words)) + coalesce(lead(words - 3 * least(linked, words)) OVER o, 0) AS score FROM counted WINDOW o AS (PARTITION BY page_id ORDER BY position)),
good AS (SELECT *, score > 0 AND 100 * score >= 15 * max(score) OVER (PARTITION BY page_id) AND 100 * linked <= 33 * words AS good FROM scored),
kept AS (SELECT *, CASE WHEN heading THEN coalesce(lead(good) OVER (PARTITION BY page_id ORDER BY position), false) OR (good AND words > 3) ELSE good END AS kept FROM good)"""


@query(f"WITH {_CONTENT_SQL} SELECT page_id, position::INT AS position, heading, words::INT AS words, linked::INT AS linked, score::INT AS score, kept FROM kept")
def content_blocks(spark, d):
    return parsing.content_blocks(T(spark, d, "pages")).drop("raw")


@query(rf"""WITH {_CONTENT_SQL} SELECT page_id, replace(replace(replace(replace(replace(string_agg(trim(regexp_replace(raw, '\s+', ' ', 'g')), chr(10) || chr(10) ORDER BY position), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&') AS text
FROM kept WHERE kept GROUP BY page_id""")
def main_content(spark, d):
    return parsing.main_content(T(spark, d, "pages"))


@query("""SELECT item_id, round(coalesce(n_read, 0) / n_lines, 6) AS share FROM (SELECT item_id, len(string_split(text, ' ')) AS n_lines, len(list_filter(string_split(text, ' '), lambda w: length(w) > 3)) AS n_read FROM benchmark)""")
def refined_query_share(spark, d):
    """How much of each question its first refinement keeps."""
    from quarryline.plans.answer import longer_words

    kept = F.filter(F.split(longer_words(F.col("text"), F.lit(1)), " "), lambda w: w != "")
    return T(spark, d, "benchmark").select("item_id", F.round(F.size(kept) / F.size(F.split("text", " ")), 6).alias("share"))


@query("SELECT doc_id, sha256('{\"v\":{\"lang\":\"' || lang || '\",\"n\":' || n_chars || '}}') AS hash FROM documents")
def data_hash(spark, d):
    return T(spark, d, "documents").select("doc_id", ids.data_hash(F.struct("lang", F.col("n_chars").alias("n"))).alias("hash"))


@query("SELECT doc_id, regexp_extract(source, '[^/]*$') || '_' || substr(md5(source), 1, 8) AS dir FROM documents")
def output_dirs(spark, d):
    return T(spark, d, "documents").select("doc_id", ids.output_dir(F.col("source")).alias("dir"))


@query("SELECT doc_id, chunk_index, chunk_text AS text FROM (" + _CHUNKS.format(step=448, size=512) + ")")
def chunk_payload(spark, d):
    chunks = chunking.chunker("fixed", size=512, overlap=None)(T(spark, d, "documents").select("doc_id", "text"))
    return files.payload(chunks.withColumn("text", F.col("chunk_text")).withColumn("parent_text", F.lit("not kept")))
