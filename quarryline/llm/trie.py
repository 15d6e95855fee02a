"""Prefix trie of conversations (operator 13).

A conversation's first d turns have a digest: the xor of a 128-bit hash of each (depth, role,
text), so prefixes of any length are prefix sums, taken in blocks of ``BLOCK`` turns and over
the blocks. A node is a digest; its owner is its smallest member. Who owns a prefix owns all
longer ones of its own, so each conversation owns a chain that begins at its *first owned
depth*. That depth is found by binary search: each round looks up one digest for every open
conversation in the table of least members (two joins). Conversations with equal turns search
once, by their smallest. Chains hang on the chain that owns the node above their first one;
what hangs is summed by doubling the distance to the ancestor that a chain reports to, so the
rounds follow the logarithm of the nesting. Within a chain, suffix sums go by blocks too.

The ids that end at a node are sorted by range, joined to strings of bounded size, and these
are streamed through SHA-256 in order: no task holds a node's ids.

Defined results: turns are ordered by turn, null first; ties by role, text's first characters
and a hash, so repeated rows are turns of their own; null role or text is empty; rows with a
null conversation id are no conversation and are left out; an empty table gives no nodes;
texts may have any length, only their hashes and word counts travel. Columns other than the
four named are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import discard, materialize, tune

#: Turns of a conversation that one window holds.
BLOCK = 512
#: Characters of joined ids that travel as one row.
IDS_CHARS = 1 << 16
#: Conversations of a family share the first turns of its least.
FAMILY, SHARED = 20, 4
_PREFIX = Window.unboundedPreceding


def number_turns(turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, part, mid, e1, e2, words) sorted by conversation and turn over the parts of a written table, and
    its blocks (conv_id, part, first_mid, n, before): turn numbers follow by addition, however many parts a conversation spans."""
    said = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    rows = turns.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.substring(said[0], 1, 32).alias("r"), F.substring(said[1], 1, 32).alias("t"),
        *[F.xxhash64(F.lit(i), *said).alias(f"e{i}") for i in (1, 2)], F.regexp_count(said[1], F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.xxhash64(F.monotonically_increasing_id()).alias("spread"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "r", "t", "e1", "e2", "spread"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(rows.select("conv_id", "e1", "e2", "words", F.monotonically_increasing_id().alias("mid")).withColumn("part", F.shiftright("mid", 33)), "turns")
    blocks = rows.groupBy("conv_id", "part").agg(F.min("mid").alias("first_mid"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(_PREFIX, -1))
    return rows, materialize(blocks.withColumn("before", F.coalesce(before, F.lit(0))), "turn_blocks")


def rebuild(rows: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, size) and their rebuilt turns (conv_id, depth, size, words, x1, x2): up to ``h`` turns of the
    family's least conversation, then the own ones after the first h."""
    convs = blocks.groupBy("conv_id").agg(F.sum("n").alias("n")).select(
        "conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    )
    bases = convs.where(F.col("conv_id") == F.col("base")).select("base", F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = materialize(convs.select("conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "convs")
    # The blocks carry what a row must know, so a conversation of very many turns is joined by part.
    about = blocks.join(convs.select("conv_id", "h", "m", "size"), "conv_id").drop("n")
    numbered = rows.join(about, ["conv_id", "part"]).withColumn("j", F.col("mid") - F.col("first_mid") + F.col("before") + 1)
    own = numbered.where("j > h").select("conv_id", (F.col("m") + F.col("j") - F.col("h")).alias("depth"), "size", "words", "e1", "e2")
    heads = numbered.where((F.col("conv_id") % FAMILY == 0) & (F.col("j") < SHARED)).select(F.col("conv_id").alias("base"), "j", "words", "e1", "e2")
    heads = convs.join(heads, "base").where("j <= h").select("conv_id", F.col("j").alias("depth"), "size", "words", "e1", "e2")
    both = own.unionByName(heads)
    return convs.select("conv_id", "size"), both.select("conv_id", "depth", "size", "words", *[F.xxhash64("depth", f"e{i}", F.lit(i)).alias(f"x{i}") for i in (1, 2)])


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, depth, size, words, d1, d2): the digest of every prefix of at least one turn."""
    rebuilt = rebuilt.withColumn("block", F.floor((F.col("depth") - 1) / BLOCK))
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(_PREFIX, 0)
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(_PREFIX, -1)
    blocks = rebuilt.groupBy("conv_id", "block").agg(*[F.bit_xor(f"x{i}").alias(f"b{i}") for i in (1, 2)])
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"b{i}").over(ahead), F.lit(0)).alias(f"o{i}") for i in (1, 2)])
    inner = rebuilt.select("conv_id", "block", "depth", "size", "words", *[F.bit_xor(f"x{i}").over(within).alias(f"w{i}") for i in (1, 2)])
    out = inner.join(blocks, ["conv_id", "block"])
    return out.select("conv_id", "depth", "size", "words", *[F.col(f"w{i}").bitwiseXOR(F.col(f"o{i}")).alias(f"d{i}") for i in (1, 2)])


def first_owned(paths: DataFrame, minima: DataFrame, state: DataFrame) -> DataFrame:
    """(conv_id, size, first) by binary search; ``first`` is size + 1 for a conversation that owns nothing.

    ``state`` holds (conv_id, size, lo, hi): the first owned depth is known to lie in lo..hi."""
    look, least = paths.select("conv_id", "depth", "d1", "d2"), minima.select("depth", "d1", "d2", "owner")
    state = materialize(state, "search")
    while not state.where("lo < hi").isEmpty():
        middle = F.floor((F.col("lo") + F.col("hi")) / 2)
        asked = state.where("lo < hi").withColumn("depth", middle).join(look, ["conv_id", "depth"]).join(least, ["depth", "d1", "d2"])
        mine = F.col("owner") == F.col("conv_id")
        moved = asked.select("conv_id", "size", F.when(mine, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(mine, F.col("depth")).otherwise(F.col("hi")).alias("hi"))
        old, state = state, materialize(state.where("lo = hi").unionByName(moved), "search")
        discard(old)
    return state.select("conv_id", "size", F.col("lo").alias("first"))


def chain_totals(chains: DataFrame) -> DataFrame:
    """(conv_id, all_saved, all_leaves): each chain's own (saved, leaves) and those of all chains below it."""
    cur = materialize(chains.select("conv_id", F.col("parent").alias("up"), F.col("saved").alias("all_saved"), F.col("leaves").alias("all_leaves")), "totals")
    while not cur.where(F.col("up").isNotNull()).isEmpty():
        # So far a chain knows the chains up to 2^k above it; next it hears from those twice as far.
        given = cur.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("conv_id")).agg(F.sum("all_saved").alias("s"), F.sum("all_leaves").alias("l"))
        further = cur.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        moved = cur.join(given, "conv_id", "left").join(further, "up", "left")
        old, cur = cur, materialize(moved.select("conv_id", F.col("next").alias("up"), *[(F.col(f"all_{n}") + F.coalesce(n[0], F.lit(0))).alias(f"all_{n}") for n in ("saved", "leaves")]), "totals")
        discard(old)
    return cur.drop("up")


def _joined(batches):
    """Rows (size, d1, d2, conv_id) in order to rows (size, d1, d2, first, ids) of bounded length."""
    key, ids, first, chars = None, [], 0, 0
    schema = pa.schema([("size", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])

    def row():
        return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in (*key, first)], pa.array([",".join(ids)])], schema=schema)

    for batch in batches:
        for *now, conv in zip(*[batch.column(c).to_pylist() for c in ("size", "d1", "d2", "conv_id")], strict=True):
            if ids and (now != key or chars > IDS_CHARS):
                yield row()
                ids, chars = [], 0
            if not ids:
                key, first = now, conv
            ids.append(str(conv))
            chars += len(ids[-1]) + 1
    if ids:
        yield row()


def _hashed(batches):
    key, sha = None, None
    out: list[tuple] = []

    def flush():
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], names=["depth", "d1", "d2", "ends_sha256"])

    for batch in batches:
        for *now, ids in zip(*[batch.column(c).to_pylist() for c in ("size", "d1", "d2", "ids")], strict=True):
            if now == key:
                sha.update(b",")
            else:
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = now, hashlib.sha256()
            sha.update(ids.encode())
        if len(out) > 1000:
            yield flush()
            out = []
    if key is not None:
        out.append((*key, sha.hexdigest()))
        yield flush()


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, d1, d2, ends_sha256) of the nodes at which conversations (size, d1, d2, conv_id) end."""
    tune(ends.sparkSession)
    by = ["size", "d1", "d2", "conv_id"]
    strings = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_joined, "size long, d1 long, d2 long, first long, ids string")
    strings = strings.repartition("size", "d1", "d2").sortWithinPartitions("size", "d1", "d2", "first")
    return strings.mapInArrow(_hashed, "depth long, d1 long, d2 long, ends_sha256 string")


def _below(nodes: DataFrame, names: list[str]) -> DataFrame:
    """``nodes`` with each named column summed over the node and the deeper ones of its chain."""
    nodes = nodes.withColumn("block", F.floor(F.col("depth") / BLOCK))
    within = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(_PREFIX, 0)
    ahead = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(_PREFIX, -1)
    blocks = nodes.groupBy("conv_id", "block").agg(*[F.sum(n).alias(f"b_{n}") for n in names])
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.sum(f"b_{n}").over(ahead), F.lit(0)).alias(f"o_{n}") for n in names])
    inner = nodes.withColumns({f"w_{n}": F.sum(n).over(within) for n in names})
    out = inner.join(blocks, ["conv_id", "block"])
    return out.withColumns({n: F.col(f"w_{n}") + F.col(f"o_{n}") for n in names}).drop("block", *[f"{p}_{n}" for n in names for p in "wo"])


def prefix_trie(turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    rows, blocks = number_turns(turns, key=key, turn=turn, role=role, text=text)
    convs, rebuilt = rebuild(rows, blocks)
    pre = materialize(prefixes(rebuilt), "prefixes")
    discard(rows, blocks)
    zero: list[Column] = [F.lit(0).cast("long").alias(c) for c in ("d1", "d2")]
    minima = pre.groupBy("depth", "d1", "d2").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"))
    root = convs.agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs")).where("owner IS NOT NULL")
    root = root.select(F.lit(0).cast("long").alias("depth"), *zero, "owner", "n_convs", F.lit(0).cast("long").alias("words"))
    minima = materialize(minima.unionByName(root), "minima")
    ends = pre.where("depth = size").select("size", "d1", "d2", "conv_id").unionByName(convs.where("size = 0").select(F.col("size").cast("long"), *zero, "conv_id"))
    ends = materialize(ends, "ends")

    # Of conversations with the same turns the least searches; only the root's owner begins at depth 0.
    top = minima.where("depth = 0").select(F.col("owner").alias("top"))
    searching = ends.groupBy("size", "d1", "d2").agg(F.min("conv_id").alias("conv_id")).join(top, F.col("conv_id") == F.col("top"), "left")
    lo, hi = F.when(F.col("top").isNull(), 1).otherwise(0), F.when(F.col("top").isNull(), F.col("size") + 1).otherwise(0)
    found = first_owned(pre, minima, searching.select("conv_id", "size", lo.cast("long").alias("lo"), hi.cast("long").alias("hi")))
    owned = found.where(F.col("first") <= F.col("size")).withColumn("at", F.col("first") - 1)
    above = owned.join(pre.select("conv_id", F.col("depth").alias("at"), "d1", "d2"), ["conv_id", "at"], "left")
    above = above.withColumns({c: F.when(F.col("at") == 0, F.lit(0).cast("long")).otherwise(F.col(c)) for c in ("d1", "d2")})
    up = minima.select(F.col("depth").alias("at"), "d1", "d2", F.col("owner").alias("parent"))
    chains = materialize(above.join(up, ["at", "d1", "d2"], "left").select("conv_id", "first", "size", "parent", "at"), "chains")

    hanging = chains.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.count(F.lit(1)).alias("hanging"))
    bare = chains.select("conv_id", F.col("size").alias("depth")).join(hanging, ["conv_id", "depth"], "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    own = minima.groupBy(F.col("owner").alias("conv_id")).agg(F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    own = chains.join(own, "conv_id").join(bare, "conv_id", "left").withColumn("leaves", F.coalesce("leaf", F.lit(0)).cast("long"))
    totals = chain_totals(own)

    # What is known of a node beside its own row: its chain begins there, ends there, or others hang there.
    none = [F.lit(None).cast("long").alias(c) for c in ("parent", "hanging", "h_saved", "h_leaves")]
    starts = chains.select("conv_id", F.col("first").alias("depth"), "parent", *none[1:], F.lit(1).alias("starts"), F.lit(0).alias("stops"))
    stops = chains.select("conv_id", F.col("size").alias("depth"), *none, F.lit(0).alias("starts"), F.lit(1).alias("stops"))
    hung = chains.where(F.col("parent").isNotNull()).join(totals, "conv_id").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth"))
    hung = hung.agg(F.count(F.lit(1)).alias("hanging"), F.sum("all_saved").alias("h_saved"), F.sum("all_leaves").alias("h_leaves"))
    hung = hung.select("conv_id", "depth", none[0], "hanging", "h_saved", "h_leaves", F.lit(0).alias("starts"), F.lit(0).alias("stops"))
    marks = starts.unionByName(stops).unionByName(hung).groupBy("conv_id", "depth").agg(*[F.max(c).alias(c) for c in ("parent", "hanging", "h_saved", "h_leaves", "starts", "stops")])

    nodes = minima.withColumnRenamed("owner", "conv_id").join(marks, ["conv_id", "depth"], "left")
    nodes = nodes.withColumn("n_children", F.coalesce("hanging", F.lit(0)) + 1 - F.coalesce("stops", F.lit(0)))
    nodes = nodes.withColumn("parent_conv_id", F.when(F.coalesce("starts", F.lit(0)) == 1, F.col("parent")).otherwise(F.col("conv_id")))
    nodes = nodes.withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words") + F.coalesce("h_saved", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", F.coalesce("h_leaves", F.lit(0)) + (F.col("n_children") == 0).cast("long"))
    nodes = materialize(nodes.select("conv_id", "depth", "d1", "d2", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), "nodes")
    nodes = _below(nodes, ["n_leaves", "saved_tokens"])
    nodes = nodes.join(ends_digest(ends), ["depth", "d1", "d2"], "left")
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )
