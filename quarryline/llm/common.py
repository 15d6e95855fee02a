"""Shared plumbing of the training-data operators.

* ``materialize`` cuts lineage with a table written under ``spark.checkpoint.dir``.
* ``text_chunks`` turns Arrow text columns into flat byte buffers of bounded size.
* ``word_spans`` / ``hash_words`` / ``window_hash`` are vectorised over such a buffer:
  no Python object is made per word, so memory follows the buffer, not the vocabulary.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, i.e. ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at once in a Python worker, so that its arrays of 8 bytes for each stay
#: near the processor; a longer document is handled alone.
CHUNK_BYTES = 1 << 19
#: Rows of an Arrow batch sent to a Python worker.
BATCH_ROWS = 1000
#: Bytes of such a batch; a larger row is a batch of its own.
BATCH_BYTES = 8 << 20

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse mod 2**64
_INV = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches: a batch of long documents must fit a Python worker and, outside
    the heap, the executor that fills it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not path:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quarryline-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Shuffle files are removed as soon as the table is written: the plan above them is not run
    again. A task that is lost before that runs its stages anew, as ever.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_ql_path"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and no plan to come reads."""
    for t in tables:
        path = t.__dict__.pop("_ql_path", None)
        if path:
            spark = t.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer parts than there are cores is dealt out evenly before heavy work on its rows; larger ones stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def flat_text(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a text column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    offs = offs.astype(np.int64)
    return data[offs[0] : offs[-1]], offs - offs[0]


def text_chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of at most ``limit`` bytes, or one row."""
    data, offs = flat_text(col)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray, blank: np.ndarray = _WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the row it lies in; ``blank`` says which bytes part words."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    ws = np.frombuffer(data.tobytes().translate(blank.tobytes()), bool)
    word = ~ws
    start, end = word.copy(), word.copy()
    start[1:] &= ws[:-1]
    end[:-1] &= ws[1:]
    full = offs[1:] > offs[:-1]
    at, to = offs[:-1][full], offs[1:][full] - 1
    start[at] = word[at]
    end[to] = word[to]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(s, offs)))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(bytearray(data.tobytes().translate(_LOWER.tobytes())), np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        out = []
        for base in (_BASE, _INV):
            p = np.full(n, base, _U)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            out.append(p)
        if n > 4 << 20:  # of one giant document: not kept
            return tuple(out)
        _powers = tuple(out)
    return _powers


def hash_words(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever the span lies."""
    up, down = _pow_tables(len(data) + 1)
    pref = np.zeros(len(data) + 1, _U)
    sums = pref[1:]
    sums[:] = data
    sums += _U(1)
    sums *= up[: len(data)]
    np.cumsum(sums, out=sums)
    return mix((pref[e] - pref[s]) * down[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93))


def window_hash(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of each run of ``k`` neighbouring values: a random multiplier for each place."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    rng = np.random.default_rng(seed)
    mult = rng.integers(1, 1 << 63, k, dtype=np.uint64) * _U(2) + _U(1)
    out = np.zeros(n, _U)
    for i in range(k):
        out += h[i : i + n] * mult[i]
    return mix(out)


def same_row(row: np.ndarray, k: int) -> np.ndarray:
    """Starts of the windows of ``k`` words that stay within one row."""
    n = len(row) - k + 1
    return np.flatnonzero(row[:n] == row[k - 1 :]) if n > 0 else np.zeros(0, np.int64)


def crc32_column(col: str) -> str:
    return f"crc32(cast(coalesce({col}, '') as binary))"
