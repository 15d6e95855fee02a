"""Approximate nearest neighbours on shifted space-filling curves (operator 10).

Each of ``curves`` orderings projects the vectors onto ``dims`` orthonormal directions of
its own, shifts the grid by a random offset, and sorts rows by Hilbert key, ties by a hash of
the vector. Rows of a curve are range-partitioned into blocks of about ``BLOCK_ROWS`` by
borders from a sample of the keys; a query is compared with the blocks within ``window`` (a
share of all rows) on either side of its own block, and what the curves find is merged and
reranked by the exact distance.

The window is a share of the rows, so recall does not fall as the table grows; what it
costs is rows x queries x share, done in blocks of matrix products, and a query is sent to
one block in ``BLOCK_ROWS`` of the rows it is compared with. Vectors without structure in many
dimensions need a large share: the README has the measured curve.

Defined results: rows whose vector is null, zero, of another length than ``dim`` or holds
null or non-finite components take no part. Equal vectors are one point of the curve, with
their k + 1 smallest ids, so a vector that fills a third of the table costs one row and
ties still go to the smaller id. Repeated ids with the same vector count once; with different
vectors, such an id's nearest of all its vectors count. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import materialize, mix, tune

_U = np.uint64


def hilbert_key(grid: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of rows of non-negative grid coordinates (Skilling's transpose form)."""
    x = [grid[:, i].astype(_U) for i in range(grid.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = _U(q - 1)
        for i in range(n):
            hit = (x[i] & _U(q)) != 0
            t = np.where(hit, _U(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & _U(q)) != 0, t ^ _U(q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << _U(1)) | (((x[i] ^ t) >> _U(b)) & _U(1))
    return key.astype(np.int64)


def curve_frames(dim: int, curves: int, dims: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Directions and shift of each curve."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(curves):
        basis, _ = np.linalg.qr(rng.standard_normal((dim, min(dims, dim))))
        out.append((basis, rng.random(basis.shape[1])))
    return out


def curve_keys(x: np.ndarray, frame: tuple[np.ndarray, np.ndarray], bits: int, scale: float = 1.0) -> np.ndarray:
    """Keys of vectors whose usual norm is ``scale``: a grid over three times the usual spread in
    each direction, shifted by under a cell's width of the coarsest half. Norms are kept, as
    nearness is that of the original vectors; what lies beyond the grid goes to its edge."""
    basis, shift = frame
    spread = scale * 3.0 / np.sqrt(x.shape[1])
    at = np.nan_to_num((x @ basis / spread + 1.0 + shift) / 3.0)
    return hilbert_key(np.clip(at * (1 << bits), 0, (1 << bits) - 1).astype(np.int64), bits)


#: Points from whose keys the block borders are set (8 bytes for each curve on the driver); every point is indexed.
SAMPLE_POINTS = 200_000
#: Points from which the usual norm is taken.
NORM_POINTS = 1000
#: Rows of a block of one curve that meet in one task, on average.
BLOCK_ROWS = 8192

_POINT = "curve int, block int, wants boolean, pid long, vk long, ids array<long>, vec binary"


def ordered_keys(x: np.ndarray, vk: np.ndarray, frame, bits: int, scale: float, curve: int = 0) -> np.ndarray:
    """Curve keys with 7 bits of a hash below, so that a key many vectors share can be cut: another
    hash for each curve, so that such vectors meet others in every one."""
    return curve_keys(x, frame, bits, scale) << 7 | (mix(vk.view(_U) ^ _U(curve + 1)) & _U(127)).astype(np.int64)


def _sampler(frames, bits: int, scale: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, vk = _matrix(batch.column("vec")), batch.column("vk").to_numpy()
                keys = np.stack([ordered_keys(x, vk, f, bits, scale, c) for c, f in enumerate(frames)], 1)
                cuts = pa.array(np.arange(0, keys.size + 1, len(frames), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(cuts, pa.array(keys.ravel()))], names=["keys"])

    return run


def valid_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int | None) -> DataFrame:
    v = F.col("vec")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(v.isNotNull() & F.col("vec_id").isNotNull() & (F.size(v) > 0))
    if dim is None:
        dim = rows.agg(F.mode(F.size(v))).first()[0] or 0
    odd = F.exists(v, lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")))
    return rows.where((F.size(v) == dim) & ~odd & F.exists(v, lambda a: a != 0.0))


def distinct_points(rows: DataFrame, wants, k: int) -> DataFrame:
    """One row for each distinct vector: its k + 1 smallest ids and whether a query has it."""
    first = Window.partitionBy("vec").orderBy("vec_id")
    least = (
        rows.distinct()
        .withColumn("rn", F.row_number().over(first))
        .where(F.col("rn") <= k + 1)
        .groupBy("vec")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    asked = rows.groupBy("vec").agg(F.max(wants).alias("wants"))
    return least.join(asked, "vec").select(F.col("ids")[0].alias("pid"), F.xxhash64("vec").alias("vk"), "ids", "wants", "vec")


def _matrix(col) -> np.ndarray:
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(a.flatten(), np.float64).reshape(len(a), -1)


def _placer(frames, borders, bits: int, scale: float, reach: int):
    """Rows for the curves: each point once, and each query point in every block of its window."""

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"))
            raw = [r.tobytes() for r in x]
            pid, vk = batch.column("pid").to_numpy(), batch.column("vk").to_numpy()
            who = np.flatnonzero(batch.column("wants").to_numpy(zero_copy_only=False).astype(bool))
            ids = batch.column("ids")
            for c, frame in enumerate(frames):
                block = np.searchsorted(borders[c], ordered_keys(x, vk, frame, bits, scale, c), "right")
                rows, at = [np.arange(len(x))], [block]
                for d in range(-reach, reach + 1):
                    b = block[who] + d
                    ok = who[(b >= 0) & (b <= len(borders[c]))]
                    rows.append(ok)
                    at.append(block[ok] + d)
                flag = np.arange(sum(map(len, rows))) >= len(x)
                rows = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows), c, np.int32)),
                        pa.array(np.concatenate(at).astype(np.int32)),
                        pa.array(flag),
                        pa.array(pid[rows]),
                        pa.array(vk[rows]),
                        ids.take(pa.array(rows)),
                        pa.array([raw[i] for i in rows], pa.binary()),
                    ],
                    names=["curve", "block", "wants", "pid", "vk", "ids", "vec"],
                )

    return place


def _searcher(k: int):
    def search(group: pa.Table) -> pa.Table:
        asked = group.column("wants").to_numpy().astype(bool)
        x = np.frombuffer(b"".join(group.column("vec").to_pylist()), np.float64).reshape(len(asked), -1)
        q, p = np.flatnonzero(asked), np.flatnonzero(~asked)
        pid, vk, ids = group.column("pid").to_numpy(), group.column("vk").to_numpy(), group.column("ids").to_pylist()
        out: list[list] = [[], [], [], []]
        take = min(k + 8, len(p))
        pts = x[p]
        norm = (pts * pts).sum(1)
        for lo in range(0, len(q) if take else 0, 256):
            part = q[lo : lo + 256]
            near = norm[None] - 2 * (x[part] @ pts.T)
            best = np.argpartition(near, take - 1, axis=1)[:, :take]
            for i, row in zip(part, best, strict=True):
                dist = np.sqrt(((pts[row] - x[i]) ** 2).sum(1))
                found = sorted((d, v) for d, j in zip(dist.tolist(), p[row], strict=True) for v in ids[j])[: k + 1]
                out[0] += [pid[i]] * len(found)
                out[1] += [vk[i]] * len(found)
                out[2] += [v for _, v in found]
                out[3] += [d for d, _ in found]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["pid", "vk", "vec_id", "score"])

    return search


def hilbert_search(
    df: DataFrame,
    wants,
    *,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    curves: int = 16,
    dims: int = 8,
    bits: int = 7,
    window: float = 0.03,
    seed: int = 17,
    dim: int | None = None,
) -> DataFrame:
    """The k nearest found of each row for which ``wants`` (a column over ``vec_id``) holds."""
    tune(df.sparkSession)
    rows = valid_vectors(df, id_col, vec_col, dim)
    points = materialize(distinct_points(rows, wants, k), "points")
    n = points.count()
    queries = rows.where(wants).select(F.col("vec_id").alias("query_id"), "vec").distinct()
    queries = queries.join(points.select("vec", "pid", "vk"), "vec").select("query_id", "pid", "vk")

    def drawn(most: int) -> DataFrame:
        return points.where(F.pmod(F.xxhash64("vk"), F.lit(max(1, -(-n // most)))) == 0).select("vk", "vec")

    x = _matrix(drawn(NORM_POINTS).select("vec").toArrow().column("vec")) if n else np.zeros((0, 1))
    x = x if len(x) or not n else _matrix(points.limit(1).select("vec").toArrow().column("vec"))
    frames, borders, scale, reach = [], [], 1.0, 0
    if n:
        frames, scale = curve_frames(x.shape[1], curves, dims, seed), float(np.median(np.linalg.norm(x, axis=1)))
        keys = drawn(SAMPLE_POINTS).mapInArrow(_sampler(frames, bits, scale), "keys array<long>").toArrow().column("keys")
        keys = np.asarray(keys.combine_chunks().flatten(), np.int64).reshape(-1, curves)
        # At least as many blocks as let a window be cut out, but blocks of 50 rows in a small table.
        blocks = max(1, min(n // 50, max(2 * round(1 / window), n // BLOCK_ROWS)))
        cut = np.linspace(0, 1, blocks + 1)[1:-1]
        borders = [np.quantile(keys[:, c], cut, method="lower") if len(keys) else np.zeros(0, np.int64) for c in range(curves)]
        reach = int(np.ceil(window * blocks))
    placed = points.mapInArrow(_placer(frames, borders, bits, scale, reach), _POINT)
    found = placed.groupBy("curve", "block").applyInArrow(_searcher(k), "pid long, vk long, vec_id long, score double")
    merged = found.groupBy("pid", "vk", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("pid", "vk").orderBy("score", "vec_id")
    merged = merged.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1)
    near = queries.join(merged.drop("rn"), ["pid", "vk"]).where(F.col("vec_id") != F.col("query_id"))
    best = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
