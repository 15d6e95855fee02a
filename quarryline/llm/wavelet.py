"""Token ids as one wavelet matrix per shard (operator 1).

A shard file holds the ids of a run of documents, in ascending id order, as bit planes from
the highest bit down. After each plane the ids are parted stably, zeros first, so a rank in
one plane leads to the place in the next. Planes are cut into blocks that are compressed on
their own, with the count of ones before each, so access, rank and select read a few blocks; the
reader counts an unpacked block's ones every 512 bits.

File layout (little endian): magic, u32 header length, JSON header, then the sections it
names: document ids, null flags, document lengths, per-plane block directory, blocks.

Defined results: null text is empty, so such a document holds its end id alone; null ids
come before all others; rows with equal ids stand in the order of their texts' hash; an empty table gives
no file and no rows; a document longer than a shard is a shard's only one or nearly so.
Other columns are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import materialize, shared_dir, text_chunks, tune
from quarryline.llm.tokens import ENCODE_BYTES, encoder, public_path

MAGIC = b"QLWM0001"
#: Bits of a plane in one compressed block.
BLOCK_BITS = 1 << 17
#: Bits of a block between two counts of its ones.
STEP_BITS = 512
SUFFIX = ".qlwm"


def pack_wavelet(ids: np.ndarray, doc_ids: np.ndarray, null_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The bytes of a shard file. ``lengths`` are tokens per document, in file order."""
    zip_ = zstandard.ZstdCompressor(level=1)
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    cur = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    planes, blobs, at = [], [], 0
    for level in range(levels - 1, -1, -1):
        ones = (cur & cur.dtype.type(1 << level)).astype(bool)
        packed = np.packbits(ones, bitorder="little")
        blocks = []
        for lo in range(0, len(packed), BLOCK_BITS // 8):
            part = packed[lo : lo + BLOCK_BITS // 8]
            blob = zip_.compress(part.tobytes())
            blocks.append([at, len(blob), int(np.bitwise_count(part).sum())])
            blobs.append(blob)
            at += len(blob)
        zeros, where = np.flatnonzero(~ones), np.flatnonzero(ones)
        planes.append({"zeros": len(zeros), "blocks": blocks})
        cur = np.concatenate([cur.take(zeros), cur.take(where)])
    tables = [zip_.compress(a.tobytes()) for a in (doc_ids.astype("<i8"), null_ids.astype("u1"), lengths.astype("<i8"))]
    head = json.dumps({"tokens": len(ids), "docs": len(doc_ids), "levels": levels, "block_bits": BLOCK_BITS, "tables": [len(t) for t in tables], "planes": planes}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *tables, *blobs])


class WaveletFile:
    """A shard file's bytes: token access, counting and occurrence lookup without unpacking it all."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a wavelet shard file")
        (n,) = struct.unpack("<I", raw[8:12])
        self.head, self.raw, at = json.loads(raw[12 : 12 + n]), raw, 12 + n
        self.tokens, self.levels, self.bits = self.head["tokens"], self.head["levels"], self.head["block_bits"]
        tables = []
        for size, kind in zip(self.head["tables"], ("<i8", "u1", "<i8"), strict=True):
            tables.append(np.frombuffer(zstandard.decompress(raw[at : at + size]), kind))
            at += size
        self.doc_ids, self.null_ids, self.lengths = tables
        self.base, self.planes = at, self.head["planes"]
        self.before = [np.cumsum([0, *[b[2] for b in p["blocks"]]]) for p in self.planes]
        self._block = lru_cache(64)(self._counted)

    def _read(self, level: int, k: int) -> np.ndarray:
        at, size, _ = self.planes[level]["blocks"][k]
        return np.frombuffer(zstandard.decompress(self.raw[self.base + at : self.base + at + size]), np.uint8)

    def _counted(self, level: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A block, and the ones before each ``STEP_BITS`` of it."""
        part = self._read(level, k)
        ones = np.bitwise_count(part).astype(np.int64)
        return part, np.concatenate([[0], np.add.reduceat(ones, np.arange(0, len(ones), STEP_BITS // 8)).cumsum()])

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k, r = divmod(i, self.bits)
        n = int(self.before[level][k])
        if r:
            part, sums = self._block(level, k)
            step, rest = divmod(r, STEP_BITS)
            n += int(sums[step])
            if rest:
                at = step * STEP_BITS // 8
                n += int(np.unpackbits(part[at : at + (rest + 7) // 8], count=rest, bitorder="little").sum())
        return n

    def _bit(self, level: int, i: int) -> int:
        k, r = divmod(i, self.bits)
        return int(self._block(level, k)[0][r >> 3] >> (r & 7)) & 1

    def access(self, i: int) -> int:
        """Token at position i."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = self.planes[level]["zeros"] + ones if bit else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.levels or token < 0:
            return 0, 0
        for level in range(self.levels):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if token >> (self.levels - 1 - level) & 1:
                lo, hi = self.planes[level]["zeros"] + a, self.planes[level]["zeros"] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token at positions [lo, hi)."""
        a, b = self._range(token, lo, self.tokens if hi is None else hi)
        return b - a

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of a kind in a plane."""
        ones = self.before[level]
        have = ones if bit else np.minimum(np.arange(len(ones)) * self.bits, self.tokens) - ones
        block = int(np.searchsorted(have, k, "right")) - 1
        bits = np.unpackbits(self._block(level, block)[0], bitorder="little")[: self.tokens - block * self.bits]
        return block * self.bits + int(np.flatnonzero(bits == bit)[k - int(have[block])])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        lo, hi = self._range(token, 0, self.tokens)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.planes[level]["zeros"] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All tokens, from the last plane up."""
        cur = np.zeros(self.tokens, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            raw = [self._read(level, k) for k in range(len(self.planes[level]["blocks"]))]
            ones = np.unpackbits(np.concatenate(raw), count=self.tokens, bitorder="little").view(bool) if raw else np.zeros(0, bool)
            zeros, out = self.planes[level]["zeros"], np.empty_like(cur)
            out[np.flatnonzero(~ones)] = cur[:zeros]
            out[np.flatnonzero(ones)] = cur[zeros:] | out.dtype.type(1 << (self.levels - 1 - level))
            cur = out
        return cur


def _encoder(borders: list, tokenizer: str, end_id: int):
    places = np.array([b[0] for b in borders], np.int64) if borders else np.zeros(0, np.int64)

    def encode(batches):
        tok, end = encoder(tokenizer), np.array([end_id], "<u4")
        for batch in batches:
            texts = batch.column("text")
            for lo, hi, data, offs in text_chunks(texts, ENCODE_BYTES):
                ids, bounds = tok.encode_flat(data, offs)
                keys = batch.column("doc_id").slice(lo, hi - lo)
                hashes = batch.column("text_hash").slice(lo, hi - lo).to_numpy()
                number = keys.fill_null(np.iinfo(np.int64).min).to_numpy()
                at = np.searchsorted(places, number, "right")
                # Borders are (key, text hash): rows with one key, and rows without one, are parted by their hash.
                for i in np.flatnonzero(np.isin(number, places)).tolist():
                    at[i] = bisect_right(borders, (int(number[i]), int(hashes[i])))
                packed, wide = [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = np.concatenate([ids[a:b], end])
                    wide.append(int(own.max()) > 0xFFFF)
                    packed.append(own.astype("<u4" if wide[-1] else "<u2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), keys, pa.array(hashes), pa.array(wide), pa.array(packed, pa.binary())], names=["shard", "doc_id", "text_hash", "wide", "ids"])

    return encode


def write_whole(folder: str, name: str, data: bytes) -> str:
    """Put a file in place at once, so that a repeated or a lost attempt leaves no half file."""
    where, path = fs.FileSystem.from_uri(folder)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(draft) as out:
        out.write(data)
    where.move(draft, f"{path}/{name}")
    return f"{path}/{name}"


def _writer(folder: str):
    def write(group: pa.Table) -> pa.Table:
        keys = group.column("doc_id").to_pylist()
        raw = [np.frombuffer(b, "<u4" if w else "<u2").astype("<u4") for b, w in zip(group.column("ids").to_pylist(), group.column("wide").to_pylist(), strict=True)]
        hashes = group.column("text_hash").to_pylist()
        order = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] or 0, hashes[i]))
        doc_ids = np.array([keys[i] or 0 for i in order], np.int64)
        nulls = np.array([keys[i] is None for i in order])
        lengths = np.array([len(raw[i]) for i in order], np.int64)
        ids = np.concatenate([raw[i] for i in order])
        shard = group.column("shard")[0].as_py()
        write_whole(folder, f"shard-{shard:08d}{SUFFIX}", pack_wavelet(ids, doc_ids, nulls, lengths))
        return pa.table({"shard": pa.array([shard], pa.int32()), "n_docs": pa.array([len(order)], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64())})

    return write


#: Documents drawn for each border between shards.
DRAWN = 16


def _borders(docs: DataFrame, shard_tokens: int) -> list[tuple[int, int]]:
    """Last (key, text hash) of every shard but the last, so that shards have about equal bytes.

    Half a byte of text counts as one token at most. Borders come from documents drawn by a
    hash with a chance in proportion to their bytes, ``DRAWN`` for each shard. The driver holds
    some 20 bytes for each drawn one, 40 MB for 1 TB of text at the default size of shards;
    larger corpora should take larger shards.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-int(size) // (2 * shard_tokens)))
    if shards == 1:
        return []
    key = F.coalesce("doc_id", F.lit(np.iinfo(np.int64).min))
    dice = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(1)), F.lit(1 << 40)) / float(1 << 40)
    wanted = F.octet_length("text") * (DRAWN * shards / size)
    weight = (F.floor(wanted) + (dice < wanted - F.floor(wanted)).cast("int")).cast("int")
    drawn = docs.select(key.alias("k"), "text_hash", weight.alias("w")).where("w > 0").orderBy("k", "text_hash").toArrow()
    keys, hashes = drawn.column("k").to_pylist(), drawn.column("text_hash").to_pylist()
    sums = np.cumsum(drawn.column("w").to_numpy())
    total = int(sums[-1]) if len(sums) else 0
    at = np.searchsorted(sums, [total * i // shards for i in range(1, shards)])
    return sorted({(keys[i], hashes[i]) for i in at.tolist() if i < len(keys)})


def write_wavelet_shards(df: DataFrame, folder: str, *, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 2, shard_tokens: int = 1 << 22) -> DataFrame:
    """Encode every text and write the shard files; returns (shard, n_docs, n_tokens).

    Shards are ranges of (key, hash of the text) with about ``shard_tokens`` ids. The text
    itself is not shuffled, only its 16-bit ids are.
    """
    spark = df.sparkSession
    tune(spark)
    tokenizer = tokenizer or public_path("byte_bpe_50k.json")
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    borders = _borders(docs, shard_tokens)
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    ids = docs.mapInArrow(_encoder(borders, tokenizer, end_id), "shard int, doc_id long, text_hash long, wide boolean, ids binary")
    return materialize(ids.groupBy("shard").applyInArrow(_writer(folder), "shard int, n_docs long, n_tokens long"), "shards")


def _read_files(batches):
    for batch in batches:
        for path, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            file = WaveletFile(raw.as_py())
            ids = file.decode().astype("<u4")
            ends = np.cumsum(file.lengths)
            crc = [zlib.crc32(ids[e - n : e]) for n, e in zip(file.lengths.tolist(), ends.tolist(), strict=True)]
            shard = int(path.rpartition("-")[2].removesuffix(SUFFIX))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(crc), shard, np.int32)),
                    pa.array(file.doc_ids, pa.int64(), mask=file.null_ids.astype(bool)),
                    pa.array(ends - file.lengths),
                    pa.array(file.lengths),
                    pa.array(crc, pa.int64()),
                ],
                names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def running_starts(sizes: DataFrame, key: str, size: str, wide: int = 1024) -> DataFrame:
    """(key, start): the sum of ``size`` over smaller keys; no window holds more than ``wide`` rows, or rows / wide."""
    groups = sizes.groupBy(F.floor(F.col(key) / wide).alias("g")).agg(F.sum(size).alias("s"))
    prior = Window.partitionBy(F.lit(0)).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("g", F.coalesce(F.sum("s").over(prior), F.lit(0)).alias("base"))
    within = Window.partitionBy("g").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("g", F.floor(F.col(key) / wide)).withColumn("part", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return sizes.join(groups, "g").select(key, (F.col("base") + F.col("part")).alias("start"))


def read_wavelet_shards(folder: str, shards: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, shard."""
    spark = shards.sparkSession
    empty = "path string, content binary"
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder) if shards.count() else spark.createDataFrame([], empty)
    docs = files.select("path", "content").mapInArrow(_read_files, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    starts = running_starts(shards.select("shard", "n_tokens"), "shard", "n_tokens")
    return docs.join(starts, "shard").select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard")


def new_folder(spark) -> str:
    return f"{shared_dir(spark)}/wavelet-{uuid.uuid4().hex}"
