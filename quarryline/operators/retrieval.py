"""Lexical, vector and fused retrieval over batches of queries.

Ranks are made over scores rounded to 6 decimals with ids breaking ties, so every engine
that repeats the arithmetic gives the same order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import tokens
from quarryline.operators.lexical import LexicalIndex, bm25_search, bm25_within, bootstrap_index, build_index, load_index, sync  # noqa: F401
from quarryline.sources import store

#: Queries and vectors of a block of the search's grid.
QUERY_ROWS, VECTOR_ROWS = 4096, 1 << 16


def rank_top(scored: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return scored.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def cosine(a: Column, b: Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def dense_search(vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", query: str = "query_id", k: int = 20, where: Column | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): exact cosine over all vectors, as a shuffled grid.

    Queries and vectors are dealt into blocks of ``QUERY_ROWS`` and ``VECTOR_ROWS``; a task multiplies
    one block of each and keeps k for each query, so no query passes through the driver and the
    last shuffle holds k rows per query and vector block. Vectors move once for each query block.
    """
    base = (vectors.where(where) if where is not None else vectors).select(F.col(key).alias("doc_id"), F.col(vector).alias("v")).where(F.col("v").isNotNull())
    asked = queries.select(F.col(query).alias("query_id"), F.col(vector).alias("q")).where(F.col("q").isNotNull())
    across, down = max(1, -(-asked.count() // QUERY_ROWS)), max(1, -(-base.count() // VECTOR_ROWS))
    dealt = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = asked.withColumn("across", dealt(across)).withColumn("down", every(down)).repartition(across * down, "across", "down")
    y = base.withColumn("down", dealt(down)).withColumn("across", every(across)).repartition(across * down, "across", "down")
    kind = queries.schema[query].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
    found = x.groupBy("across", "down").cogroup(y.groupBy("across", "down")).applyInArrow(_best_of_block(k), f"query_id {kind[0]}, doc_id {kind[1]}, score double")
    return rank_top(found, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def dense_within(vectors: DataFrame, queries: DataFrame, allowed: DataFrame, *, key: str = "vec_id", vector: str = "embedding", query: str = "query_id", k: int = 20) -> DataFrame:
    """As ``dense_search``, each query over its own vectors of ``allowed`` (query_id, doc_id) alone."""
    asked = queries.select(F.col(query).alias("query_id"), F.col(vector).alias("q")).where(F.col("q").isNotNull())
    held = vectors.select(F.col(key).alias("doc_id"), F.col(vector).alias("v")).where(F.col("v").isNotNull())
    pairs = allowed.select("query_id", "doc_id").distinct().join(asked, "query_id").join(held, "doc_id")
    score = F.round(F.coalesce(cosine(F.col("q"), F.col("v")), F.lit(0.0)), 6)
    return rank_top(pairs.select("query_id", "doc_id", score.alias("score")), ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _best_of_block(k: int, rows: int = 64):
    def run(asked: pa.Table, vectors: pa.Table) -> pa.Table:
        picks: list[tuple[int, np.ndarray, np.ndarray]] = []
        if asked.num_rows and vectors.num_rows:
            vectors = vectors.sort_by("doc_id")  # equal scores then stand in the order of their ids
            q, v = _matrix(asked.column("q")), _matrix(vectors.column("v"))
            size = np.sqrt((v * v).sum(1))
            for lo in range(0, len(q), rows):
                part = q[lo : lo + rows]
                scale = np.sqrt((part * part).sum(1))[:, None] * size[None]
                score = np.round(np.divide(part @ v.T, scale, out=np.zeros_like(scale), where=scale > 0), 6)
                least = np.partition(score, max(0, len(v) - k), axis=1)[:, max(0, len(v) - k)]
                for i, s in enumerate(score):
                    at = np.flatnonzero(s >= least[i])
                    at = at[np.argsort(-s[at], kind="stable")][:k]
                    picks.append((lo + i, at, s[at]))
        who = np.concatenate([np.full(len(at), i) for i, at, _ in picks]) if picks else np.zeros(0, np.int64)
        found = np.concatenate([at for _, at, _ in picks]) if picks else who
        scores = np.concatenate([s for *_, s in picks]) if picks else np.zeros(0)
        return pa.table({"query_id": asked.column("query_id").take(pa.array(who, pa.int64())), "doc_id": vectors.column("doc_id").take(pa.array(found, pa.int64())), "score": pa.array(scores, pa.float64())})

    return run


def rrf(lists: DataFrame, *, by: list[str], item: list[str], source: str = "list_idx", rank: str = "rank", k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: sum of 1 / (k + rank), ranks from 1; ties go to the first seen."""
    fused = lists.groupBy(*by, *item).agg(
        F.round(F.sum(1.0 / (F.lit(k) + F.col(rank))), 9).alias("rrf_score"),
        F.min(F.struct(F.col(source).alias("l"), F.col(rank).alias("r"))).alias("_seen"),
    )
    order = Window.partitionBy(*by).orderBy(F.desc("rrf_score"), "_seen.l", "_seen.r", *item)
    return fused.withColumn("rank", F.row_number().over(order)).drop("_seen")


def small_corpus_guard(variants: DataFrame, n_chunks: int, dense_top_k: int = 20) -> DataFrame:
    """A corpus of at most ``dense_top_k`` chunks is searched with the first variant alone."""
    return variants if n_chunks > dense_top_k else variants.where("variant = 0")


def hybrid_search(dense: DataFrame, sparse: DataFrame, *, k: int = 10) -> DataFrame:
    """Three fusions: the variants' dense lists, their sparse lists, then the two.

    Both inputs hold (query_id, variant, doc_id, rank); returns (query_id, doc_id, rrf_score, rank).
    """
    parts = [rrf(x, by=["query_id"], item=["doc_id"], source="variant", k=k).withColumn("list_idx", F.lit(i)) for i, x in enumerate((dense, sparse))]
    return rrf(parts[0].unionByName(parts[1]), by=["query_id"], item=["doc_id"], k=k)


def overlap_score(query: Column, text: Column) -> Column:
    """The stand-in scorer: share of the query's distinct tokens that the text has."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(F.lit(0.0))


def rerank(candidates: DataFrame, *, query: Column, text: Column, scorer=overlap_score, k: int = 5) -> DataFrame:
    """The k best candidates by the scorer; only ``score`` changes. Ties keep the fused order."""
    scored = candidates.withColumn("score", F.round(scorer(query, text), 6))
    return rank_top(scored, ["query_id"], [F.desc("score"), F.asc("rank"), F.asc("doc_id")], k, "rerank")


def rerank_fallback(candidates: DataFrame, k: int = 5) -> DataFrame:
    """Without a scorer: the first k in the given order."""
    return candidates.where(F.col("rank") <= k).withColumn("rerank", F.col("rank"))


def retrieval_decision(top_score: Column, n_results: Column, evaluated: Column | None = None, threshold: float = 0.85) -> Column:
    """No results: refine; a confident top: sufficient; else what the evaluator says."""
    return F.when(F.coalesce(n_results, F.lit(0)) == 0, "refine_query").when(top_score > threshold, "sufficient").otherwise(evaluated if evaluated is not None else F.lit("evaluate"))


def query_variants(queries: DataFrame, alternatives: Column, *, query: str = "query_id", text: str = "text") -> DataFrame:
    """The question itself as variant 0, then its alternatives."""
    return queries.select(F.col(query).alias("query_id"), F.posexplode(F.concat(F.array(F.col(text)), alternatives)).alias("variant", "query_text"))
