"""Tables, blobs and caches in any folder that Hadoop's file systems reach.

Blobs are single files under a root; a key that leaves the root is an error. Tables of the
engine's own (indexes, dumps, caches) are Parquet written whole.
"""

from __future__ import annotations

import json
import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = ".meta"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not path:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quarryline-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet at ``path`` and read back: lineage ends there, and its shuffle files go with it."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = df.sparkSession.conf.get(key)
    df.sparkSession.conf.set(key, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        df.sparkSession.conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch that is sent to a Python worker; a larger row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Batches of long texts must fit a Python worker, whatever the table's size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table of fewer parts than there are cores is dealt out by key before heavy work on its rows; larger ones stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, F.col(key)) if df.rdd.getNumPartitions() < cores else df


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return bool(fs.exists(where))


def delete(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return bool(fs.delete(where, True))


class BlobStore:
    """Blobs by key under a root URI, with an optional JSON sidecar of metadata."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, key: str) -> str:
        clean = posixpath.normpath(key)
        if not key or key.startswith("/") or clean == ".." or clean.startswith("../"):
            raise ValueError(f"key leaves the store: {key!r}")
        return f"{self.root}/{clean}"

    def _put(self, path: str, data: bytes) -> None:
        fs, where = _fs(self.spark, path)
        draft = _fs(self.spark, f"{path}.{uuid.uuid4().hex}.part")[1]
        out = fs.create(draft, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        fs.delete(where, False)
        fs.rename(draft, where)

    def upload(self, key: str, data: bytes | list, meta: dict | None = None) -> str:
        """Bytes as they are, a list of records as JSON."""
        path = self.path(key)
        self._put(path, data if isinstance(data, bytes) else json.dumps(data, default=vars).encode())
        if meta is not None:
            self._put(path + META, json.dumps(meta).encode())
        return path

    def download(self, key: str) -> bytes:
        path = self.path(key)
        if not exists(self.spark, path):
            raise FileNotFoundError(key)
        return bytes(self.spark.read.format("binaryFile").load(path).select("content").first()[0])

    def meta(self, key: str) -> dict | None:
        return json.loads(self.download(key + META)) if self.exists(key + META) else None

    def exists(self, key: str) -> bool:
        return exists(self.spark, self.path(key))

    def delete(self, key: str) -> bool:
        """The blob and its sidecar; whether there was one."""
        delete(self.spark, self.path(key + META))
        return delete(self.spark, self.path(key))

    def list(self, prefix: str = "") -> DataFrame:
        """(key, length) of the blobs whose key starts with a prefix, without sidecars."""
        empty = self.spark.createDataFrame([], "key string, length long")
        if not exists(self.spark, self.root):
            return empty
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.root)
        root = _fs(self.spark, self.root)[1].toUri().getPath().rstrip("/") + "/"
        key = F.expr(f"substring(path, locate('{root}', path) + {len(root)})")
        return files.select(key.alias("key"), "length").where(~F.col("key").endswith(META) & F.col("key").startswith(prefix))


#: Store makers by type; more can be registered.
STORES = {"local": BlobStore, "uri": BlobStore}


def make_store(kind: str, spark: SparkSession, root: str) -> BlobStore:
    if kind not in STORES:
        raise ValueError(f"unknown store: {kind}")
    return STORES[kind](spark, root)


class ParseCache:
    """Parsed results by cache key: one compressed Parquet table a version, read whole or by key.

    An entry whose JSON does not parse counts as missing and is left out of the next version,
    like one whose source file was invalidated.
    """

    SCHEMA = "cache_key string, source_file string, parsed string, size_bytes long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def entries(self) -> DataFrame:
        """What is kept, corrupt entries included."""
        path = self._newest()
        return self.spark.read.parquet(path) if path else self.spark.createDataFrame([], self.SCHEMA)

    def _versions(self) -> list[str]:
        fs, where = _fs(self.spark, self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(n for n in names if exists(self.spark, f"{self.folder}/{n}/_SUCCESS"))

    def _newest(self) -> str | None:
        found = self._versions()
        return f"{self.folder}/{found[-1]}" if found else None

    def _replace(self, rows: DataFrame) -> None:
        old = self._versions()
        number = int(old[-1].removeprefix("v")) + 1 if old else 0
        rows.select(F.expr("cache_key"), "source_file", "parsed", "size_bytes").write.option("compression", "gzip").parquet(f"{self.folder}/v{number:08d}")
        for name in old[:-1]:  # readers of the last version may still be at it
            delete(self.spark, f"{self.folder}/{name}")

    def valid(self) -> DataFrame:
        return self.entries().where(F.try_parse_json("parsed").isNotNull())

    def store(self, rows: DataFrame) -> None:
        """Add or replace (cache_key, source_file, parsed)."""
        new = rows.select("cache_key", "source_file", "parsed", F.octet_length("parsed").cast("long").alias("size_bytes")).dropDuplicates(["cache_key"])
        self._replace(self.valid().join(new, "cache_key", "left_anti").select("cache_key", "source_file", "parsed", "size_bytes").unionByName(new))

    def get(self, keys: DataFrame) -> DataFrame:
        """(cache_key, parsed) with null where nothing valid is kept."""
        return keys.select("cache_key").join(self.valid().select("cache_key", "parsed"), "cache_key", "left")

    def invalidate(self, source_file: str) -> int:
        """Entries of a file that went."""
        gone = self.entries().where(F.col("source_file") == source_file).count()
        if gone:
            self._replace(self.valid().where(~F.col("source_file").eqNullSafe(F.lit(source_file))))
        return gone


def dump_ingest(chunks: DataFrame, embedded: DataFrame | None, folder: str, key: str = "doc_id", documents: DataFrame | None = None) -> None:
    """The ingest outputs ``chunks`` and ``embedded_chunks``, of which each run replaces its documents' own parts.

    ``documents`` (key) names the documents of the run: one that now gives no chunk loses those it had."""
    spark = chunks.sparkSession
    for name, rows in (("chunks", chunks), ("embedded_chunks", embedded)):
        if rows is not None:
            part, path = rows.withColumn("part", _part_of(key)), f"{folder}/{name}"
            if not exists(spark, path):
                part.write.partitionBy("part").parquet(path)
                continue
            mine = rows if documents is None else rows.select(key).unionByName(documents.select(F.col(key).cast(rows.schema[key].dataType).alias(key)))
            # Written, its size is known: few keys are broadcast, so that the rows that stay are not shuffled.
            mine = written(mine.select(key).distinct().withColumn("part", _part_of(key)), scratch_path(spark, name))
            touched = sorted(r.part for r in mine.select("part").distinct().collect())  # at most 64
            stay = spark.read.parquet(path).where(F.col("part").isin(touched)).join(mine.select(key), key, "left_anti")
            # The touched parts are written once, beside those they replace, and then take their names.
            draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
            stay.unionByName(part, allowMissingColumns=True).write.partitionBy("part").parquet(draft)
            for n in touched:  # a part that is left without rows was not written
                delete(spark, f"{path}/part={n}")
                if exists(spark, f"{draft}/part={n}"):
                    fs, at = _fs(spark, f"{draft}/part={n}")
                    if not fs.rename(at, _fs(spark, f"{path}/part={n}")[1]):
                        raise OSError(f"{draft}/part={n} could not take its place in {path}")
            delete(spark, draft)


def _part_of(key: str):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(64)).cast("int")


def dump_json(blocks: DataFrame, path: str) -> None:
    """Content blocks as lines of JSON."""
    blocks.write.mode("overwrite").json(path)
