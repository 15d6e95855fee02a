"""Jump consistent hashing of stable keys to shards (operator 4), in built-in functions only.

The walk is that of jump consistent hashing: from bucket b, draw r in (0, 1] from the key
and b, and jump to floor((b + 1) / r); the last bucket below the shard count is the shard.
A key keeps its shard when a shard is appended unless it moves into the new one. The draw
is 52 bits of md5(key ':' b), so that any SQL engine can repeat it.

Defined results: a null key hashes as the word "null"; null text counts as empty; rows
that are equal in every way are numbered one after another; a text of any length counts by
its bytes; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import crc32_column


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a key; at most ``shards`` jumps, as each goes up."""
    text = F.coalesce(key.cast("string"), F.lit("null"))

    def step(b: Column, _: Column) -> Column:
        hexa = F.substring(F.md5(F.concat(text, F.lit(":"), b.cast("string"))), 1, 13)
        draw = (F.conv(hexa, 16, 10).cast("double") + 1) / F.lit(float(1 << 52))
        to = F.floor((b + 1) / draw)
        return F.when((b < 0) | (to >= shards), F.when(b < 0, b).otherwise(-b - 1)).otherwise(to).cast("long")

    # A walk that has ended is kept as -b - 1, which needs no further draw.
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), F.lit(0).cast("long"), step)
    return F.when(walk < 0, -walk - 1).otherwise(walk).cast("int")


def shard_documents(df: DataFrame, shards: int = 8, *, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Each row's shard, its gapless slot there, and its shard were there one more.

    Slots are numbered within ``parts`` pieces of a shard, after the rows of the pieces
    before: no task holds a whole shard, and the table of piece sizes has shards * parts
    rows at most.
    """
    parts = parts or 256
    rows = df.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.expr(crc32_column(f"`{text}`")).alias("text_crc32"),
    )
    rows = rows.withColumns({"law": F.lit("key"), "shard": jump_shard(F.col("doc_id"), shards), "grown_shard": jump_shard(F.col("doc_id"), shards + 1)})
    mark = F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32"))), 1, 8)
    rows = rows.withColumn("part", F.pmod(F.conv(mark, 16, 10).cast("long"), F.lit(parts)).cast("int"))
    sizes = rows.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begin"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("rn", F.row_number().over(within)).join(F.broadcast(starts), ["shard", "part"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("begin") + F.col("rn") - 1).alias("slot"), "grown_shard")
