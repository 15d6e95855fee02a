"""Packing documents into sequences by first-fit decreasing (operator 6).

A document's ids end with the end id. It is cut into whole sequences and one remainder;
remainders are placed, longest first, into the first open sequence with room. The first
fit comes from a tournament tree over the sequences' free places: the root's maximum says
if any fits, and the walk down takes the left child whenever that has room enough.

Groups are random and of about ``group_docs`` documents, so a group is one small task and
what is lost against packing all at once is a few sequences a group.

Defined results: null text is empty (its end id alone); rows with equal ids are documents
of their own; a very long text is cut into as many pieces as it needs; an empty table gives no rows. Sequence ids are unique, not gapless: group in
the upper bits, number within the group below. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import mix, text_chunks, tune
from quarryline.llm.tokens import ENCODE_BYTES, encoder, public_path

_U = np.uint64


class FreeTree:
    """Free places of bins 0, 1, ...; finds the first bin with room."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """(bin, free places there before) of the first bin that fits; takes them."""
        free, node = self.free, 1
        if free[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        had = free[node]
        free[node] = had - size
        found = node - self.leaves
        while node > 1:
            node //= 2
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
        return found, had


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, in the items' order; ties of size keep it."""
    tree, out = FreeTree(max(1, len(sizes)), capacity), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at, had = tree.place(sizes[i])
        out[i] = at, capacity - had
    return out


def _cutter(tokenizer: str, end_id: int, capacity: int, groups: int, seed: int, keep_ids: bool):
    def cut(batches):
        tok, end = encoder(tokenizer), struct.pack("<I", end_id)
        row, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            texts = batch.column("text")
            for lo, hi, data, offs in text_chunks(texts, ENCODE_BYTES):
                keys = batch.column("doc_id").slice(lo, hi - lo).to_pylist()
                cols: list[list] = [[] for _ in range(8)]
                flat, bounds = tok.encode_flat(data, offs)
                raw = flat.astype("<u4", copy=False).tobytes()
                for key, first, last in zip(keys, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    ids = raw[4 * first : 4 * last] + end
                    n = len(ids) // 4
                    # Rows with equal ids or texts fall into different groups: the place of the row is mixed in.
                    dice = mix(np.array([((key or 0) & 0xFFFFFFFFFFFFFFFF) ^ (part << 40) ^ (row << 8) ^ seed], _U))[0]
                    row += 1
                    for start in range(0, n, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        for c, v in zip(cols, (int(dice % _U(groups)), key, start, len(piece) // 4, zlib.crc32(piece), n, row, piece if keep_ids else None), strict=True):
                            c.append(v)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["grp", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "row", "ids"])

    return cut


def _packer(capacity: int):
    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("ids_crc32", "ascending"), ("row", "ascending"), ("start", "ascending")])
        sizes = group.column("length").to_pylist()
        grp = group.column("grp")[0].as_py()
        at = first_fit_decreasing(sizes, capacity)
        fill: dict[int, int] = {}
        for (b, _), size in zip(at, sizes, strict=True):
            fill[b] = fill.get(b, 0) + size
        return pa.table(
            [
                *[group.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")],
                pa.array([(grp << 32) + b for b, _ in at], pa.int64()),
                pa.array([o for _, o in at], pa.int64()),
                pa.array([fill[b] for b, _ in at], pa.int64()),
                group.column("ids"),
            ],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "ids"],
        )

    return pack


def pack_documents(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 1, capacity: int = 2048, group_docs: int = 4096, seed: int = 6, keep_ids: bool = True
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_tokens (filled places of its sequence) and, with ``keep_ids``, the ids as
    little-endian unsigned 32-bit integers."""
    tune(df.sparkSession)
    groups = max(1, -(-df.count() // group_docs))
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cut = docs.mapInArrow(
        _cutter(tokenizer or public_path("word_bpe_49k.json"), end_id, capacity, groups, seed, keep_ids),
        "grp int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long, ids binary",
    )
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, ids binary"
    out = cut.groupBy("grp").applyInArrow(_packer(capacity), schema)
    return out if keep_ids else out.drop("ids")
