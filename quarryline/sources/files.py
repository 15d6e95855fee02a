"""File scans, format dispatch, the parse cache and the chunk store as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions.ids import point_id
from quarryline.schemas import PAYLOAD
from quarryline.sources.store import exists

#: Extensions by parser; fixed values.
HTML = (".html", ".htm", ".xhtml")
OFFICE = (".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx")
TEXT = (".txt", ".md")
SUPPORTED = (*HTML, *OFFICE, *TEXT, ".pdf")
#: Extensions of plain text.
PLAIN = (".txt", ".md")
#: MIME types by extension; fixed values of the formats themselves.
MIME_TYPES = {
    "html": "text/html",
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "jpg": "image/jpeg",
    "png": "image/png",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def scan_files(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """Supported files: path, modificationTime, length, content. Paths that are not there are skipped."""
    paths = [p for p in paths if exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true").load(paths)
    return files.where(suffix(F.col("path")).isin(*SUPPORTED))


def parse_route(path: Column) -> Column:
    """Which parser takes a file; what no parser takes is set apart."""
    s = suffix(path)
    return F.when(s == ".pdf", "pdf").when(s.isin(*HTML), "html").when(s.isin(*OFFICE), "office").otherwise("quarantine")


def chunk_strategy(path: Column) -> Column:
    return F.when(suffix(path).isin(*SUPPORTED), "recursive_character").otherwise("fixed")


def mime_type(path: Column) -> Column:
    """Null for an extension without one."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv]), F.substring(suffix(path), 2, 10))


def page_ranges(pages: Column, most: int = 20) -> Column:
    """(first, last) page ranges of at most ``most`` pages, from 0."""
    starts = F.when(pages > 0, F.sequence(F.lit(0), pages - 1, F.lit(most))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("first"), F.least(s + most, pages).alias("end")))


def upsert(new: DataFrame, old: DataFrame | None = None, version: str = "ingest_ts") -> DataFrame:
    """Rows by point id, the last version of each; ties of version go to the larger text."""
    rows = old.unionByName(new, allowMissingColumns=True) if old is not None else new
    rows = rows.withColumn("point_id", point_id(F.col("doc_id"), F.col("chunk_index")))
    last = Window.partitionBy("point_id").orderBy(F.col(version).desc(), F.col("text").desc())
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def payload(chunks: DataFrame) -> DataFrame:
    return chunks.select(*[c for c in PAYLOAD if c in chunks.columns])


def assert_dimension(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Fails the job at the first vector of another length."""
    return df.where(F.assert_true(F.size(vector) == dim, F.lit("vector dimension mismatch")).isNull())


def cache_misses(files: DataFrame, manifest: DataFrame, key: str = "cache_key") -> DataFrame:
    return files.join(manifest.select(key).distinct(), key, "left_anti")


def invalidate(manifest: DataFrame, source_file: str) -> DataFrame:
    return manifest.where(~F.col("source_file").eqNullSafe(F.lit(source_file)))


def cache_stats(manifest: DataFrame, size: str = "size_bytes") -> DataFrame:
    return manifest.agg(F.count(F.lit(1)).alias("entries"), F.round(F.coalesce(F.sum(size), F.lit(0)) / 1048576, 2).alias("size_mb"))


def batch_summary(status: DataFrame, ok: str = "ok") -> DataFrame:
    """Files parsed and failed, and the rate in percent, 0 of nothing."""
    good, total = F.coalesce(F.sum(F.col(ok).cast("long")), F.lit(0)), F.count(F.lit(1))
    return status.agg(good.alias("successful"), (total - good).alias("failed"), total.alias("total")).withColumn(
        "success_rate", F.when(F.col("total") > 0, F.col("successful") / F.col("total") * 100).otherwise(F.lit(0.0))
    )
