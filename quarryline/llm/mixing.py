"""Mixing sources to target weights by Poisson replication (operator 9), in built-in functions only.

A source's target repetition rate is its target share of the mix over its share of the
corpus. Each document's count is the Poisson quantile, with that mean, of a uniform draw
hashed from seed and document; the document is exploded by its count, and all copies are
shuffled globally by a hashed key.

Target weights default to ``share ** temper`` (tempered sampling), normalised over the
sources. With ``weights`` given, a source without one gets weight 0 and so no copies. The
mix holds ``total`` times the corpus's size, size being UTF-8 bytes plus one.

Defined results: null text counts as empty, null source is a source of its own, a null id
hashes as "null"; repeated rows draw alike unless their ids differ; an empty table gives
no rows; texts of any length are carried whole. Columns of the input are kept but for those
named like the added ones (the caller's prefix and rate, count, copy, key), which give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import materialize


#: Bytes of text in a partition of the shuffled mix, at most on average; never fewer partitions than the session's.
PART_BYTES = 128 << 20


def hashed_uniform(*parts: Column) -> Column:
    """52 bits of md5 over the parts, as a double in [0, 1)."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_steps(mean: Column) -> Column:
    """Cumulative probabilities for 0, 1, ... of a Poisson variable with a mean of at most 16, to beyond the last bit of a draw."""
    last = F.ceil(mean + 9 * F.sqrt(mean) + 12).cast("int")
    first = F.exp(-mean)
    start = F.struct(first.alias("term"), first.alias("sum"), F.array(first).alias("steps"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * mean / k
        total = acc["sum"] + term
        return F.struct(term.alias("term"), total.alias("sum"), F.concat(acc["steps"], F.array(total)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["steps"])


def poisson_parts(mean: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(mean / 16)).cast("int")


def poisson_quantile(u: Column, mean: Column, steps: Column | None = None) -> Column:
    """Least n whose cumulative Poisson probability exceeds u.

    Means over 16 are split into equal parts of at most 16, each inverted with bits of its
    own (from u hashed again), as a sum of Poisson variables is Poisson; so exp(-mean)
    never underflows. ``steps``, those of one part, may be made once for each source.
    """
    parts = poisson_parts(mean)
    steps = poisson_steps(mean / parts) if steps is None else steps

    def one(draw: Column) -> Column:
        return F.size(F.filter(steps, lambda s: s <= draw))

    more = F.aggregate(F.sequence(F.lit(2), parts), F.lit(0), lambda acc, i: acc + one(hashed_uniform(u, i)))
    return one(u) + F.when(parts > 1, more).otherwise(0)


def source_rates(df: DataFrame, *, source: str = "source", text: str = "text", weights: dict[str, float] | None = None, temper: float = 0.5, total: float = 1.0) -> DataFrame:
    """Target repetition rate of each source: (source, size, rate)."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    sizes = df.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(temper))
    else:
        listed = F.coalesce(*[F.when(F.col("source") == k, F.lit(float(v))) for k, v in weights.items()], F.lit(0.0)) if weights else F.lit(0.0)
        weight = listed
    sizes = materialize(sizes.withColumn("weight", weight), "sources")
    all_size, all_weight = sizes.agg(F.sum("size"), F.sum("weight")).first()
    if not all_weight:
        return sizes.select("source", "size", F.lit(0.0).alias("rate"))
    share = F.col("weight") / F.lit(float(all_weight))
    return sizes.select("source", "size", (F.lit(float(total)) * F.lit(all_size) * share / F.col("size")).alias("rate"))


def poisson_mix(
    df: DataFrame,
    *,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: dict[str, float] | None = None,
    temper: float = 0.5,
    total: float = 1.0,
    seed: int = 9,
    prefix: str = "mix_",
    shuffle: bool = True,
) -> DataFrame:
    """Every row repeated by its Poisson count, with {prefix}rate, {prefix}count, {prefix}copy
    (from 0) and {prefix}key, the position in the global order; a partition holds whole
    slices of that key, sorted."""
    spark = df.sparkSession
    rates = source_rates(df, source=source, text=text, weights=weights, temper=temper, total=total)
    rates = materialize(rates.select("source", "size", "rate", poisson_steps(F.col("rate") / poisson_parts(F.col("rate"))).alias("steps")), "rates")
    # Names of the operator's own: a column of the input with such a name gives way.
    own = [prefix + x for x in ("rate", "count", "copy", "key")]
    rates_of = rates.select(F.struct("source", "rate", "steps").alias("__ql_rate"))
    kept = df.select(F.struct(*[df[c] for c in df.columns if c not in own]).alias("__ql_row"))
    row = F.col("__ql_row")
    # Tables of sources are small as a rule; the planner broadcasts one by its measured size or else joins by shuffle.
    out = kept.join(rates_of, row[source].eqNullSafe(F.col("__ql_rate")["source"]))
    u = hashed_uniform(F.lit(seed), row[key])
    out = out.withColumn("__ql_count", poisson_quantile(u, F.col("__ql_rate")["rate"], F.col("__ql_rate")["steps"])).where(F.col("__ql_count") > 0)
    out = out.withColumn("__ql_copy", F.explode(F.sequence(F.lit(0), F.col("__ql_count") - 1)))
    place = hashed_uniform(F.lit(seed), F.lit("order"), row[key], F.col("__ql_copy"))
    out = out.select(row, F.col("__ql_rate")["rate"].alias("__ql_rate"), "__ql_count", "__ql_copy", place.alias("__ql_key"))
    if shuffle:
        # The key is uniform on [0, 1), so equal slices are equal parts: no sampling pass as a range partitioner makes.
        size = rates.agg(F.coalesce(F.sum(F.col("size") * F.col("rate")), F.lit(0.0))).first()[0]
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // PART_BYTES))
        piece = F.least(F.floor(F.col("__ql_key") * n), F.lit(n - 1)).cast("int")
        out = out.repartitionById(n, piece).sortWithinPartitions("__ql_key")
    return out.select(*[row[c].alias(c) for c in df.columns if c not in own], *[F.col(f"__ql_{x}").alias(prefix + x) for x in ("rate", "count", "copy", "key")])
