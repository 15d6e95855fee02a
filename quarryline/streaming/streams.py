"""Incremental ingest and sessions with a time to live, as Structured Streaming queries."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarryline.functions.ids import point_id
from quarryline.sources import store
from quarryline.sources.files import upsert

SESSION_TTL_S = 7200
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts of the ingested table; a micro-batch rewrites those alone that it touches.
PARTS = 64


#: Manifests that are kept: of the last batch, the one that a repeated batch reads, and one more for readers.
KEPT = 3


def _manifests(spark: SparkSession, target: str) -> list[int]:
    fs, where = store._fs(spark, f"{target}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def _parts(spark: SparkSession, target: str, epoch: int) -> dict[int, str]:
    """Folder of each part (under the target) as the newest batch up to ``epoch`` left it."""
    found = [e for e in _manifests(spark, target) if e <= epoch]
    if not found:
        return {}
    said = store.BlobStore(spark, target).download(f"manifest/{found[-1]:012d}.json")
    return {int(k): v for k, v in json.loads(said).items()}


def read_ingested(spark: SparkSession, target: str, epoch: int = 1 << 62) -> DataFrame | None:
    """The table as it stands: each part's newest version."""
    paths = [f"{target}/{p}" for p in _parts(spark, target, epoch).values()]
    return spark.read.parquet(*paths) if paths else None


def merge_batch(batch: DataFrame, epoch: int, target: str, parts: int = PARTS) -> None:
    """Upsert a batch: the parts it touches are written anew, one file each, and a manifest names every part's newest folder.

    The manifest is written last and replaces the batch's own if it is repeated, so readers see a batch whole or not at all.
    Of older manifests ``KEPT`` stay; folders that none of them names are deleted: listing and disk follow the table, not
    the number of batches.
    """
    spark, target = batch.sparkSession, target.rstrip("/")
    new = batch.withColumn("part", F.pmod(F.xxhash64(point_id(F.col("doc_id"), F.col("chunk_index"))), F.lit(parts)).cast("int"))
    new = store.written(new, store.scratch_path(spark, "batch"))
    touched = [r.part for r in new.select("part").distinct().collect()]  # at most ``parts``
    before = _parts(spark, target, epoch - 1)
    held = [f"{target}/{path}" for k, path in before.items() if k in touched]
    old = None
    for k in [k for k in before if k in touched]:
        piece = spark.read.parquet(f"{target}/{before[k]}").drop("point_id").withColumn("part", F.lit(k))
        old = piece if old is None else old.unionByName(piece, allowMissingColumns=True)
    upsert(new, old if held else None).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{target}/version={epoch}")
    now = before | {k: f"version={epoch}/part={k}" for k in touched}
    blobs = store.BlobStore(spark, target)
    blobs.upload(f"manifest/{epoch:012d}.json", json.dumps(now).encode())
    known = _manifests(spark, target)
    named = {p for e in known[-KEPT:] for p in _parts(spark, target, e).values()}
    for e in known[:-KEPT]:
        for path in set(_parts(spark, target, e).values()) - named:
            store.delete(spark, f"{target}/{path}")
        blobs.delete(f"manifest/{e:012d}.json")


def ingest_stream(stream: DataFrame, target: str, checkpoint: str, *, parts: int = PARTS):
    """Upsert each micro-batch into a table of ``parts`` parts by point id, of which it rewrites those it touches.

    A repeated batch reads the versions before its own and writes its own anew, so a restart after
    a lost driver changes nothing. ``parts`` must stay the same for a table.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        merge_batch(batch, epoch, target, parts)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Sessions(StatefulProcessor):
    """A session's turn count, latest event and last turns; a timer ends it ``ttl_ms`` after the latest event."""

    def __init__(self, ttl_ms: int, keep: int):
        self.ttl_ms, self.keep = ttl_ms, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n long, latest long")
        self.recent = handle.getListState("recent", "turn long, ts long, line string")

    def _row(self, key, n: int, lines: list[str], expired: bool) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [key[0]], "n_turns": [n], "recent": [lines], "expired": [expired]})

    def handleInputRows(self, key, rows, timerValues):
        n, latest = self.seen.get() if self.seen.exists() else (0, 0)
        held = [tuple(x) for x in self.recent.get()] if self.recent.exists() else []
        for pdf in rows:
            n += len(pdf)
            latest = max(latest, int(pdf["ms"].max()))
            held += zip(pdf["turn"].tolist(), pdf["ms"].tolist(), pdf["line"].tolist(), strict=True)
            held = sorted(held)[-self.keep :]  # a late turn takes its place among the others
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # A turn that comes late does not bring the end forward: it follows the latest turn so far.
        self.handle.registerTimer(max(latest + self.ttl_ms, timerValues.getCurrentWatermarkInMs() + 1))
        self.seen.update((n, latest))
        self.recent.put(held)
        yield self._row(key, n, [x[2] for x in held], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        n, _ = self.seen.get()
        lines = [x[2] for x in self.recent.get()]
        self.seen.clear()
        self.recent.clear()
        yield self._row(key, n, lines, True)

    def close(self) -> None:
        pass


def session_stream(turns: DataFrame, *, ttl_s: int = SESSION_TTL_S, keep: int = 10, late: str = "10 minutes") -> DataFrame:
    """(session_id, n_turns, recent, expired): sessions that end ``ttl_s`` after their last write, by event time ``ts``.

    State holds the last ``keep`` turns of a session by turn number, not the session. Sessions with
    state and timers need the RocksDB state store, which the session is set to.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    rows = turns.withWatermark("ts", late).select("session_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), line.alias("line"), F.unix_millis("ts").alias("ms"), "ts")
    return rows.groupBy("session_id").transformWithStateInPandas(Sessions(ttl_s * 1000, keep), "session_id string, n_turns long, recent array<string>, expired boolean", "Update", "EventTime")
