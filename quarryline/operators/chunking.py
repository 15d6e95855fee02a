"""Table-generating chunkers: fixed windows in built-in functions, recursive splitting per batch."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from functools import partial
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quarryline.sources import store
from quarryline.sources.parsers import Registry

SEPARATORS = ("```", "| ---", "\n\n", "\n", " ")


def fixed_windows(df: DataFrame, *, text: str = "text", size: int = 512, overlap: int = 64) -> DataFrame:
    """Windows of ``size`` words every ``size - overlap``, each the original text from its first to its last word.

    Adds chunk_index and chunk_text; a text without words gives no rows. A trailing window
    is given even if the one before already holds it.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    spans = df.withColumn("_w", F.regexp_extract_all(F.col(text), F.lit(r"\s*\S+"), F.lit(0))).where(F.size("_w") > 0)
    index = F.explode(F.sequence(F.lit(0), F.floor((F.size("_w") - 1) / step).cast("int"))).alias("chunk_index")
    spans = spans.select(*df.columns, "_w", index)
    piece = F.array_join(F.slice("_w", F.col("chunk_index") * step + 1, F.lit(size)), "")
    return spans.select(*df.columns, "chunk_index", F.regexp_replace(piece, r"^\s+", "").alias("chunk_text"))


def parent_windows(df: DataFrame, *, doc: str = "doc_id", index: str = "chunk_index", text: str = "text", width: int = 3) -> DataFrame:
    """Each chunk with the texts around it: parent_text, parent_start, parent_end, parent_tokens."""
    half, order = width // 2, Window.partitionBy(doc).orderBy(index)
    place = F.row_number().over(order) - 1
    total = F.count(F.lit(1)).over(Window.partitionBy(doc))
    joined = F.array_join(F.collect_list(text).over(order.rowsBetween(-half, half)), " ")
    out = df.withColumns({"parent_text": joined, "parent_start": F.greatest(F.lit(0), place - half), "parent_end": F.least(total, (place + half + 1).cast("long"))})
    return out.withColumn("parent_tokens", F.size(F.filter(F.split("parent_text", r"\s+"), lambda w: w != "")))


def packed_spans(lengths: list[int], gap: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans [i, j) of neighbouring parts, ``gap`` between two of them: each as long as ``size`` allows, and each
    begins with as many of the last one's parts as ``overlap`` allows and leave room for the part that follows.

    With the parts' running sums, both borders of a span are searches in a sorted list.
    """
    ends = list(accumulate(lengths, lambda total, n: total + n + gap, initial=0))
    spans, first = [], 0
    while first < len(lengths):
        last = max(first + 1, bisect_right(ends, ends[first] + gap + size) - 1)
        spans.append((first, last))
        if last == len(lengths):
            break
        first = min(last, bisect_left(ends, max(ends[last] - overlap, ends[last + 1] - size) - gap, first))
    return spans


def split_recursively(text: str, size: int, overlap: int, separators=SEPARATORS, length: Callable[[str], int] = lambda s: len(s.split())) -> list[str]:
    """Pieces of at most ``size``: a text is parted at the first separator it holds, runs of parts under ``size``
    are packed, and a part that is longer is parted again at the separators after; none left, it stays whole."""
    place = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    separator, finer = separators[place], separators[place + 1 :]
    pieces: list[str] = []
    measured = ((part, length(part)) for part in text.split(separator) if part)
    for fits, run in groupby(measured, key=lambda m: m[1] < size):
        parts = list(run)
        if fits:
            spans = packed_spans([n for _, n in parts], length(separator), size, overlap)
            pieces += [separator.join(part for part, _ in parts[i:j]) for i, j in spans]
        else:
            for part, _ in parts:
                pieces += split_recursively(part, size, overlap, finer, length) if finer else [part]
    return pieces


def recursive_chunks(df: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 1200, overlap: int = 100, length: Callable[[str], int] | None = None) -> DataFrame:
    """(key, chunk_index, chunk_text, token_count); blank pieces are left out but counted by the index."""
    measure = length or (lambda s: len(s.split()))

    def run(batches):
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                if t is None or not t.strip():
                    continue
                pieces = [(i, p.strip()) for i, p in enumerate(split_recursively(t, max(size, 1), max(overlap, 0), length=measure))]
                rows += [(k, i, p, measure(p)) for i, p in pieces if p] or [(k, 0, t.strip(), measure(t.strip()))]
            yield pd.DataFrame(rows, columns=["k", "chunk_index", "chunk_text", "token_count"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, chunk_index int, chunk_text string, token_count int")
    return out.withColumnRenamed("k", key)


#: Chunkers by name; a new one is registered with a maker that gives a function of a DataFrame.
CHUNKERS = Registry("chunker")
CHUNKERS.register("fixed", lambda **options: partial(fixed_windows, **options))
CHUNKERS.register("recursive_character", lambda **options: partial(recursive_chunks, **options))


def chunker(name: str, **options) -> Callable[..., DataFrame]:
    """The named chunker with the options that are not None; an unknown name is an error."""
    return CHUNKERS.make(name, **options)


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


_PIECE = re.compile(r"\s*\S+", re.ASCII)


@udtf(useArrow=True)
class ChunkText:
    """``chunk_text(TABLE(docs) [PARTITION BY (key)], 'text', 512, 64)`` in SQL: the rows with chunk_index and chunk_text, as ``fixed_windows``.

    The table's own columns pass through; the text column is named by the second argument."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument must be a table: chunk_text(TABLE(name), ...)")
        if text.value not in rows.dataType.fieldNames():
            raise ValueError(f"the table has no column {text.value!r}")
        if overlap.value >= size.value:
            raise ValueError("overlap must be smaller than size")
        return AnalyzeResult(schema=StructType([*rows.dataType.fields, StructField("chunk_index", IntegerType()), StructField("chunk_text", StringType())]))

    def eval(self, row, text, size, overlap):
        words = _PIECE.findall(row[text] or "")
        for i, at in enumerate(range(0, len(words), size - overlap)):
            yield (*row, i, "".join(words[at : at + size]).lstrip(" \t\n\r\f\v"))


def register(spark: SparkSession, name: str = "chunk_text") -> str:
    """Make the chunker callable from SQL by ``name``; texts then reach Python in bounded batches."""
    store.bound_batches(spark)
    spark.udtf.register(name, ChunkText)
    return name
