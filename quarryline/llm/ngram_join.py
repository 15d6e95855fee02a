"""Similarity join of shingle sets by token-combination prefixes (operator 7).

Tokens are shingles of ``words`` words (3 in operator 7), as 64-bit hashes; a document's set
links with another's at a Jaccard similarity of at least ``threshold`` percent. With n tokens, a linked set misses at
most d = n - ceil(n * threshold / 100) of them. The global order is (zone, class, hash): the
lowest part of the hash range (a quarter at 90 percent) is the first zone, and in a zone rare tokens come first. A prefix takes tokens in that order until it holds
d + l units: a rare token is one unit, and in a subclass of frequent tokens every token
after the first is one. Losing a token costs a unit at most, so linked sets share l units:
l rare tokens, or else a pair of frequent tokens of one subclass. Rare tokens are indexed
alone, frequent ones in pairs within their subclass. The subclasses' number follows the
size of the set (a power of two of sets of 32), so pairs grow with a set and not with its
square; a set whose partners may lie on either side of such a step is indexed for both.

Classes: a token is frequent if more than ``often`` distinct sets hold it in the part of
their tokens from which prefixes are taken: the first zone, or all tokens of a set whose
first zone might not suffice.

Verification is exact. Rare tokens' buckets give pairs, which are kept if they share enough
of them. A bucket of a pair of frequent tokens, or of more than ``often`` sets, gives edges
to its smallest set alone, and the components of those edges are groups in which links may
lie. Each member is verified against the one smallest set it shares most buckets with, like
any pair. What that links is one class already; in tiles of bounded size, dealt by hash, only
sets of different classes are then compared, by matrix products, and a tile returns a forest,
not its pairs. So a large group of near copies costs a comparison with its hub for each, and
only what its hub does not link costs tiles.

Equal sets are one set from the start. The graph is over ids, so rows with equal ids count
as one document. Defined results: null or wordless text has an empty set and no link; fewer
than ``words`` words are one token; a null id counts as the largest and returns as null; an empty
table gives no rows; a text of any length is one set. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import discard, hash_words, lower_ascii, materialize, mix, text_chunks, tune, window_hash, word_spans
from quarryline.llm.components import components

_U = np.uint64
_LAST = np.iinfo(np.int64).max
SHINGLE = 3
#: Sets that may share a rare token, and so the sets of a bucket whose pairs are listed.
OFTEN = 32
#: Frequent tokens (8 bytes each) that are sent to every task; more are joined by shuffle.
BROADCAST_TOKENS = 1 << 20
#: Tokens (and 1500 for each set) of one side of a tile.
TILE = 1_500_000


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, ascending, and the rows' bounds in them."""
    n = len(offs) - 1
    data = lower_ascii(data)
    s, e, row = word_spans(data, offs)
    h = hash_words(data, s, e)
    words = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(words)])
    full = window_hash(h, k, 29)
    inside = np.flatnonzero(row[: len(full)] == row[k - 1 :]) if len(full) else np.zeros(0, np.int64)
    value, at = [full[inside]], [row[inside]]
    for m in range(1, k):
        short = np.flatnonzero(words == m)
        value.append(mix(window_hash(h, m, 31 + m)[first[short]] if len(short) else np.zeros(0, _U)))
        at.append(short)
    value, at = np.concatenate(value), np.concatenate(at)
    order = np.lexsort((value, at))
    value, at = value[order], at[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1])
    value, at = value[new], at[new]
    return value, np.searchsorted(at, np.arange(n + 1))


def _allowed(n: int, percent: int) -> int:
    """Tokens of a set of n that a linked set may lack."""
    return n - -(-n * percent // 100)


def _shared(n: int) -> int:
    """Units that two linked sets of this size must share."""
    return 1 + min(3, n // 16)


def _level(n: int) -> int:
    return max(0, (max(1, n // 32)).bit_length() - 1)


def _zone(percent: int) -> np.uint64:
    """End of the first zone of the hash range: 2.5 times the share of tokens that a linked set may lack."""
    return _U(min((1 << 64) * (100 - percent) // 40, (1 << 64) - 1))


def _need(n: int, percent: int) -> int:
    return _allowed(n, percent) + _shared(n)


def _reserve(zone: int, n: int, percent: int) -> int:
    """Tokens from which a prefix is taken: the first zone's, if they are enough were all of them frequent."""
    return zone if zone - (1 << _level(n * 100 // percent)) >= _need(n, percent) else n


def _measure(percent: int, full: bool, words: int = SHINGLE):
    zone = _zone(percent)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch.column("text")):
                value, bounds = shingle_sets(data, offs, words)
                ids = batch.column("doc_id").slice(lo, hi - lo)
                size = np.diff(bounds)
                sums = [np.concatenate([[_U(0)], np.cumsum(mix(value ^ _U(c)))]) for c in (0x51ED270B, 0xA5CB3B1D2F)]
                prints = [(x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in sums]
                none = [] if full else [batch.column("none").slice(lo, hi - lo)]
                cols = [ids, *none, pa.array(size), *map(pa.array, prints)]
                if full:
                    low = np.concatenate([[0], np.cumsum(value < zone)])
                    keep = [_reserve(int(z), n, percent) for z, n in zip(low[bounds[1:]] - low[bounds[:-1]], size.tolist(), strict=True)]
                    take = np.concatenate([np.arange(b, b + k) for b, k in zip(bounds.tolist(), keep, strict=False)]).astype(np.int64)
                    cuts = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(value[take].view(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "f1", "f2", "tokens"] if full else ["doc_id", "none", "n", "f1", "f2"])

    return run


def _prefix(tokens: np.ndarray, often: np.ndarray, need: int, parts: int, end: np.uint64) -> tuple[list, list]:
    """Rare tokens and pairs of frequent ones of the prefix with ``need`` units."""
    single: list = []
    pairs: list = []
    groups: dict[int, list] = {}
    left = need
    for zone in (tokens < end, tokens >= end):
        rare = tokens[zone & ~often][:left].tolist()
        single += rare
        left -= len(rare)
        for t in tokens[zone & often].tolist() if left else ():
            held = groups.setdefault(t % parts, [])
            pairs += [(x, t) for x in held]
            left -= bool(held)
            held.append(t)
            if not left:
                break
        if not left:
            return single, pairs
    raise AssertionError("a prefix is too short")


def signatures(tokens: np.ndarray, often: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(rare tokens' signatures, pairs' signatures) of a set; ``tokens`` are its lowest by hash."""
    need = _need(n, percent)
    single, double = set(), set()
    for level in {_level(n), _level(n * 100 // percent)}:
        rare, pairs = _prefix(tokens, often, need, 1 << level, _zone(percent))
        single.update(rare)
        double.update((a, b, level) for a, b in pairs)
    two = np.array(sorted(double), _U).reshape(-1, 3)
    return np.array(sorted(single), _U), mix(two[:, 0] * _U(0x9E3779B97F4A7C15) + mix(two[:, 1]) + two[:, 2])


def _index(percent: int):
    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for rep, n, tokens, often in zip(batch.column("rep").to_pylist(), batch.column("n").to_pylist(), batch.column("tokens"), batch.column("often"), strict=True):
                t = np.asarray(tokens.values).view(_U)
                o = np.isin(t, np.asarray(often.values).view(_U)) if often.is_valid else np.zeros(len(t), bool)
                single, double = signatures(t, o, n, percent)
                k = len(single) + len(double)
                for c, v in zip(out, ([single, double], [np.zeros(len(single), bool), np.ones(len(double), bool)], [np.full(k, rep)], [np.full(k, n)], [np.full(k, _shared(n))]), strict=True):
                    c += v
            cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0].astype(_U).view(np.int64)), pa.array(cols[1].astype(bool)), pa.array(cols[2].astype(np.int64)), pa.array(cols[3].astype(np.int32)), pa.array(cols[4].astype(np.int32))],
                names=["sig", "double", "rep", "n", "l"],
            )

    return run


def _full_sets(words: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch.column("text")):
                value, bounds = shingle_sets(data, offs, words)
                raw = value.astype("<u8")
                packed = [raw[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("rep").slice(lo, hi - lo), pa.array(packed, pa.binary())], names=["rep", "tokens"])

    return run


def _check_pairs(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                c = int((both[1:] == both[:-1]).sum())
                if 100 * c >= percent * (len(x) + len(y) - c):
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])

    return run


def link_forest(x: list[np.ndarray], y: list[np.ndarray] | None, percent: int, wide: int = 2048) -> np.ndarray:
    """Labels of the sets of x, then of y, in the graph of links between x and y, or within x."""
    sets = x + (y or [])
    size = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(value := np.concatenate(sets), kind="stable")
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    count = np.diff([*np.flatnonzero(new), len(value)])
    col = np.cumsum(new) - 1
    keep = count[col] > 1
    doc, col = doc[keep], col[keep]
    col = np.cumsum(np.concatenate([[0], (col[1:] != col[:-1]).astype(np.int64)])) if len(col) else col
    a, b = len(x), len(sets) - len(x)
    both = np.zeros((a, b or a), np.float32)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, wide):
        i, j = np.searchsorted(col, [lo, lo + wide])
        m = np.zeros((len(sets), wide), np.float32)
        m[doc[i:j], col[i:j] - lo] = 1
        both += m[:a] @ (m[a:] if y is not None else m).T
    other = size[a:] if y is not None else size
    link = 100 * both >= percent * (size[:a, None] + other[None] - both)
    label = np.arange(len(sets))
    while True:
        left, right = label[:a], label[a:] if y is not None else label[:a]
        new_left = np.minimum(left, np.where(link, right[None], len(sets)).min(1, initial=len(sets)))
        if y is None:
            step = new_left
        else:
            step = np.concatenate([new_left, np.minimum(right, np.where(link, new_left[:, None], len(sets)).min(0, initial=len(sets)))])
        if (step == label).all():
            return label
        label = step


def _check_tile(percent: int):
    def run(group: pa.Table) -> pa.Table:
        reps, side = group.column("rep").to_numpy(), group.column("side").to_numpy()
        order = np.lexsort((reps, side))
        sets = [np.frombuffer(t, "<u8") for t in group.column("tokens").to_pylist()]
        own = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        n = int((side == 0).sum())
        x, y = [sets[k] for k in order[:n]], [sets[k] for k in order[n:]]
        label = link_forest(x, None if own else y, percent)
        reps = reps[order][: len(label)]
        linked = label != np.arange(len(label))
        return pa.table({"a": pa.array(reps[linked]), "b": pa.array(reps[label[linked]])})

    return run


def _tiles(groups: DataFrame, sizes: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members of each group with the tile pairs they take part in.

    A class of linked sets that fills a tile has tiles of its own; other sets share them. Of a
    group beyond one tile, sets are parted by size first, so that only sizes that allow a link
    meet. Within these a set's tile is dealt by its hash: no task orders a whole group. Tiles
    that hold one and the same class are not compared. Tokens are joined last: nothing before
    moves them.
    """
    rows = groups.join(sizes, F.col("node") == F.col("rep")).select("component", "rep", "n")
    rows = rows.join(known.select(F.col("node").alias("rep"), F.col("component").alias("class")), "rep", "left")
    rows = materialize(rows.withColumn("class", F.coalesce("class", "rep")), "members")
    mass = F.sum(F.col("n") + 1500)
    group = rows.groupBy("component").agg(mass.alias("mass"), F.min("class").alias("a"), F.max("class").alias("b")).where("a < b")
    own = rows.groupBy("component", "class").agg(mass.alias("own")).where(F.col("own") > TILE)
    rows = rows.join(group.select("component", "mass"), "component").join(own, ["component", "class"], "left")
    step = F.when(F.col("mass") > TILE, F.floor(F.log(F.col("n")) / math.log(100 / percent))).otherwise(0).cast("int")
    rows = rows.withColumns({"pure": F.when(F.col("own").isNotNull(), F.col("class")), "step": step})
    rows = rows.withColumn("kind", F.xxhash64(F.coalesce("pure", F.lit(0)), F.col("pure").isNull(), "step"))
    parts = rows.groupBy("component", "kind").agg(F.ceil(mass / TILE).alias("parts"))
    rows = rows.join(parts, ["component", "kind"])
    rows = rows.select("component", "rep", "n", "class", F.xxhash64("kind", F.pmod(F.xxhash64("rep"), "parts")).alias("tile"))
    place = materialize(rows, "tiles")
    tiles = place.groupBy("component", "tile").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("class").alias("a"), F.max("class").alias("b"))
    x, y = (tiles.select("component", *(F.col(c).alias(c + k) for c in ("tile", "least", "most", "a", "b"))) for k in "xy")
    two = x.join(y, "component").where((F.col("tilex") <= F.col("tiley")) & (100 * F.col("mostx") >= percent * F.col("leasty")) & (100 * F.col("mosty") >= percent * F.col("leastx")))
    two = two.where(F.least("ax", "ay") < F.greatest("bx", "by"))
    both = [F.struct(F.col(c).alias("tile"), F.lit(side).alias("side")) for side, c in enumerate(("tilex", "tiley"))]
    sides = F.when(F.col("tilex") == F.col("tiley"), F.array(both[0])).otherwise(F.array(*both))
    two = two.select("component", F.col("tilex").alias("i"), F.col("tiley").alias("j"), F.explode(sides).alias("s"))
    two = two.select("component", "i", "j", "s.tile", "s.side")
    return place.select("component", "rep", "tile").join(two, ["component", "tile"]).select("component", "rep", "i", "j", "side").join(sets, "rep")


def similar_documents(df: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 90, often: int = OFTEN, words: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    tune(df.sparkSession)
    # A null id counts as the largest; the flag tells it from a document that has that id.
    docs = df.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("doc_id"), F.col(key).isNull().alias("none"), F.col(text).alias("text"))
    measured = docs.select("doc_id", "text").mapInArrow(_measure(percent, True, words), "doc_id long, n long, f1 long, f2 long, tokens array<long>")
    reps = measured.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens"))
    reps = materialize(reps, "sets")
    # A set of under 9 tokens links with an equal one at most, at 90 percent.
    least = next(n for n in range(1, 1000) if 100 * n >= percent * (n + 1))
    large = reps.where(F.col("n") >= least).select("rep", "n", "tokens")
    counts = large.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") > often).select("token")
    counts = materialize(counts, "frequent")
    # Sent to every task only while it is small; beyond that the tokens are shuffled to it.
    known = F.broadcast(counts) if counts.count() <= BROADCAST_TOKENS else counts
    held = large.select("rep", "n", F.explode("tokens").alias("token")).join(known, "token").groupBy("rep", "n").agg(F.collect_list("token").alias("often"))
    sigs = large.join(held, ["rep", "n"], "left").mapInArrow(_index(percent), "sig long, double boolean, rep long, n int, l int")
    sigs = materialize(sigs, "signatures")
    buckets = sigs.groupBy("sig", "double").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("hub")).where("size > 1")
    shared = materialize(sigs.join(buckets, ["sig", "double"]), "shared")
    discard(sigs, counts)
    few = ~F.col("double") & (F.col("size") <= often)
    lists = shared.where(few).groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("rep", "n", "l"))).alias("m"))
    pairs = lists.select(F.explode(F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x as x, y as y))))")).alias("p"))
    near = F.least("p.x.n", "p.y.n") * 100 >= F.greatest("p.x.n", "p.y.n") * percent
    pairs = pairs.where(near & (F.col("p.x.rep") != F.col("p.y.rep"))).groupBy(F.col("p.x.rep").alias("a"), F.col("p.y.rep").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min(F.least("p.x.l", "p.y.l")).alias("l"))
    pairs = materialize(pairs.where("c >= l").select("a", "b"), "pairs")
    edges = shared.where(~few & (F.col("rep") != F.col("hub"))).groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("c"))
    edges = materialize(edges, "hubs")
    discard(shared)
    groups = materialize(components(edges, "rep", "hub"), "groups")
    best = edges.groupBy("rep").agg(F.max(F.struct("c", (-F.col("hub")).alias("hub"))).alias("m")).select(F.col("rep").alias("a"), (-F.col("m.hub")).alias("b"))
    near, pairs = pairs, materialize(pairs.unionByName(best).distinct(), "to_verify")
    discard(near, edges)
    wanted = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).unionByName(groups.select(F.col("node").alias("rep"))).distinct()
    # The texts of the sets to verify move once, at every size of the corpus alike.
    sets = docs.select(F.col("doc_id").alias("rep"), "text").join(wanted.hint("merge"), "rep").mapInArrow(_full_sets(words), "rep long, tokens binary")
    sets = materialize(sets, "full")
    x, y = (sets.select(F.col("rep").alias(k), F.col("tokens").alias(c)) for k, c in (("a", "x"), ("b", "y")))
    links = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_check_pairs(percent), "a long, b long")
    links = materialize(links, "links")
    known = materialize(components(links, "a", "b"), "classes")
    forest = _tiles(groups, reps.select("rep", "n"), known, sets, percent).groupBy("component", "i", "j").applyInArrow(_check_tile(percent), "a long, b long")
    # The components are written, so what they were made of can go.
    found = materialize(components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(forest), "a", "b"), "components")
    discard(pairs, groups, sets, links, known)
    members = docs.mapInArrow(_measure(percent, False, words), "doc_id long, none boolean, n long, f1 long, f2 long")
    members = members.join(reps.drop("tokens"), ["n", "f1", "f2"], "left").join(found, F.col("rep") == F.col("node"), "left")
    own = F.coalesce("component", "rep", "doc_id")
    return members.select(
        F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(~F.col("none") | (own != F.lit(_LAST)), own).alias("component_id"),
    )


def one_of_each(df: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 90, words: int = SHINGLE) -> DataFrame:
    """The documents without those that a smaller id stands for; of rows with equal id and text one stays.

    Rows without an id come after all others, by the hash of their text. Rows without a set stay.
    """
    # Ids of their own for rows without one: beyond all ids in use, and equal for equal texts.
    own = F.coalesce(F.col(key).cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text), 2))
    docs = df.withColumn("__ql_id", own).withColumn("__ql_text", F.xxhash64(text, F.md5(text)))
    found = similar_documents(docs, key="__ql_id", text=text, percent=percent, words=words)
    gone = found.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("__ql_id")).distinct()
    kept = docs.join(gone, "__ql_id", "left_anti")
    same = ["__ql_id", "__ql_text"]
    again = materialize(docs.where(F.col(text).isNotNull()).groupBy(*same).count().where("count > 1").select(*same), "again")
    if not again.isEmpty():  # only the rows that are repeated are shuffled for the choice
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(same))
    return kept.select(*df.columns)
