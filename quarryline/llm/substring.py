"""Substring dedup by fixed-block anchors (operator 3).

A window of ``window`` = 2 * block - 1 words, wherever it starts, holds exactly one whole
block that begins at a multiple of ``block`` in its document. So two documents share a
window only if one's aligned block equals a rolling block of the other:

1. *Anchors.* Every document's aligned blocks are the index; all its rolling blocks probe
   it. Both go, as 36 bits of a hash in entries of 6 bytes packed by chunk of documents, to
   the task of their hash range, which answers each chunk with those blocks that are an
   aligned block somewhere and occur in more than one document.
2. *Extension.* Documents with hits extend them by the words around to every window that
   holds a hit; overlapping windows are one maximal repeat. A window's 128-bit hash goes to
   the task of its range, which answers with those that start in a smaller document.
3. *Removal.* Words covered by an answered window go.

Within a chunk a block or window leaves once, with its smallest document, and what the chunk
can answer it answers itself; so a passage that a third of all documents share is one entry
for each chunk, not for each document. Answers come back to the chunk and are put together
there, one row for each document however many tasks answered. Texts are never shuffled but
for documents that have hits.

Defined results: null text has no words; null ids come after all others and are judged as
one id; rows with equal ids do not remove each other's words; an empty table gives no rows.
Extra columns are left alone. A text of any length is one row of a chunk of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import discard, hash_words, materialize, mix, same_row, text_chunks, tune, window_hash, word_spans

_U = np.uint64
_LAST = np.iinfo(np.int64).max
#: Entries sent to one task of the exchange; the number of tasks grows with the corpus.
ENTRIES_PER_TASK = 3_000_000
#: Text of a chunk of documents whose equal blocks leave once, and its rows at most (10 bits).
CHUNK = 2 << 20
CHUNK_ROWS = 1 << 10
#: Bits of a block's hash that name it in an entry and in an answer. A clash only adds a window to check.
TAG_BITS = 36

_MESSAGE = "bucket int, chunk long, ids array<long>, hashes array<long>, body binary"
_REPLY = "chunk long, ids array<long>, hashes array<long>, body binary"
_ANSWER = "doc_id long, text_hash long, found binary"
#: A window on its way, and what comes back: the block's or window's hash and the document's place in the chunk.
_WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("id", "<i8"), ("doc", "<u2")])
_HIT = np.dtype([("a", "<u8"), ("doc", "<u2")])


def _ranges(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal values, and the run each place is in."""
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _chunks(batches):
    """(chunk id, first row, end row, bytes, offsets, batch) of runs of rows."""
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for lo, hi, data, offs in text_chunks(batch.column("text"), CHUNK):
            for a in range(lo, hi, CHUNK_ROWS):
                b = min(hi, a + CHUNK_ROWS)
                at = offs[a - lo : b - lo + 1]
                yield part << 32 | n, a, b, data[at[0] : at[-1]], at - at[0], batch
                n += 1


def _mail(chunk: int, buckets: int, value: np.ndarray, body: np.ndarray, ids: np.ndarray, hashes: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
    """Entries packed for the bucket of their value, and one message with the chunk's documents and own answers."""
    bucket = (mix(value ^ _U(0x2545F4914F6CDD1D)) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first, _ = _ranges(bucket[order]) if len(order) else (np.zeros(0, np.int64), None)
    body = body[order]
    to = [*bucket[order[first]].tolist(), int(mix(np.array([chunk], _U))[0] % _U(buckets))]
    raw = [body[a:b].tobytes() for a, b in zip(first, [*first[1:], len(order)], strict=False)]
    nones = [None] * len(raw)
    kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
    cols = (to, [chunk] * len(to), [*nones, ids], [*nones, hashes], [*raw, own.tobytes()])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "chunk", "ids", "hashes", "body"])


def _hits(a: np.ndarray, doc: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), _HIT)
    out["a"], out["doc"] = a, doc
    return out


def _chunk(batch, lo, hi):
    ids = batch.column("doc_id").slice(lo, hi - lo).to_numpy()
    return ids, batch.column("text_hash").slice(lo, hi - lo).to_numpy()


def _tag(g: np.ndarray) -> np.ndarray:
    return g & _U((1 << TAG_BITS) - 1)


def _anchors(block: int, buckets: int):
    """Step 1: mail of aligned and rolling blocks."""

    def post(batches):
        for chunk, lo, hi, data, offs, batch in _chunks(batches):
            ids, hashes = _chunk(batch, lo, hi)
            s, e, row = word_spans(data, offs)
            at = same_row(row, block)
            if not len(at):
                continue
            g = window_hash(hash_words(data, s, e), block, 71)[at]
            doc = row[at]
            begin = np.searchsorted(row, np.arange(len(ids)))
            aligned = (at - begin[doc]) % block == 0
            # Places by value, then document id: what this chunk knows by itself.
            order = np.lexsort((ids[doc], g))
            first, run = _ranges(g[order])
            least = ids[doc[order[first]]]
            shared = np.maximum.reduceat(ids[doc[order]], first) != least
            index = np.logical_or.reduceat(aligned[order], first)
            flags = index.astype(_U) | shared.astype(_U) << _U(1)
            mine = shared[run]
            # Rows of one id are no news to each other, but each needs its own answer.
            twin = ~mine & (doc[order] != doc[order[first]][run])
            one = np.concatenate([order[first], order[twin]])
            flags = np.concatenate([flags, flags[run[twin]]])
            entry = _tag(g[one]) << _U(12) | doc[one].astype(_U) << _U(2) | flags
            body = entry.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            yield _mail(chunk, buckets, g[one], body, ids, hashes, _hits(_tag(g[order][mine]), doc[order][mine]))

    return post


def _replies(chunks: list[int], src: np.ndarray, hits: np.ndarray, notes: list) -> pa.Table:
    """One reply for each chunk with hits (``src``: its place in ``chunks``), and the chunks' own messages unchanged."""
    order = np.argsort(src, kind="stable")
    src, hits = src[order], hits[order]
    at, _ = _ranges(src) if len(src) else (np.zeros(0, np.int64), None)
    raw = [hits[a:b].tobytes() for a, b in zip(at, [*at[1:], len(src)], strict=False)]
    nones = [None] * len(raw)
    cols = [[*(chunks[i] for i in src[at].tolist()), *(n[0] for n in notes)], *([*(nones if k < 3 else raw), *(n[k] for n in notes)] for k in (1, 2, 3))]
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["chunk", "ids", "hashes", "body"])


def _unpack(group: pa.Table) -> tuple[list[int], list[bytes], list]:
    """Chunks and bodies of the messages with entries; the chunks' own messages."""
    chunks, bodies, notes = [], [], []
    for chunk, ids, hashes, body in zip(group.column("chunk").to_pylist(), group.column("ids"), group.column("hashes"), group.column("body"), strict=True):
        if ids.is_valid:
            notes.append((chunk, ids.as_py(), hashes.as_py(), body.as_py()))
        else:
            chunks.append(chunk)
            bodies.append(body.as_py())
    return chunks, bodies, notes


def _match_anchors(group: pa.Table) -> pa.Table:
    chunks, bodies, notes = _unpack(group)
    del group
    width = np.array([len(b) // 6 for b in bodies], np.int64)
    value = np.zeros((int(width.sum()), 8), np.uint8)
    value[:, :6] = np.frombuffer(b"".join(bodies), np.uint8).reshape(-1, 6)
    del bodies
    value = value.reshape(-1).view("<u8")
    if not len(value):
        return _replies(chunks, np.zeros(0, np.int64), np.zeros(0, _HIT), notes)
    src = np.repeat(np.arange(len(chunks), dtype=np.int32), width)
    # Equal blocks stand together. Arrays are let go as soon as they are used: there are millions of entries.
    order = np.argsort(value)
    value, src = value[order], src[order]
    del order
    new = np.ones(len(value), bool)
    new[1:] = value[1:] >> _U(12) != value[:-1] >> _U(12)
    first = np.flatnonzero(new)
    flags = np.bitwise_or.reduceat(value, first) & _U(3)
    # Documents of different chunks count as different ones here: at worst a window more is checked.
    own = np.unique(np.array(chunks, np.int64), return_inverse=True)[1].astype(np.int32)[src]
    several = (np.maximum.reduceat(own, first) != np.minimum.reduceat(own, first)) | (flags & _U(2) != 0)
    del own
    hit = np.repeat(several & (flags & _U(1) != 0), np.diff(first, append=len(value)))
    value = value[hit]
    return _replies(chunks, src[hit], _hits(value >> _U(12), (value >> _U(2)) & _U(CHUNK_ROWS - 1)), notes)


def _assemble(group: pa.Table) -> pa.Table:
    """The answers to one chunk, by document."""
    note = next(i for i, x in enumerate(group.column("ids")) if x.is_valid)
    ids, hashes = (np.asarray(group.column(c)[note].values) for c in ("ids", "hashes"))
    hits = np.frombuffer(b"".join(group.column("body").to_pylist()), _HIT)
    order = np.argsort(hits["doc"], kind="stable")
    doc, a = hits["doc"][order], hits["a"][order].astype("<u8")
    at, _ = _ranges(doc) if len(doc) else (np.zeros(0, np.int64), None)
    raw = [a[i:j].tobytes() for i, j in zip(at, [*at[1:], len(doc)], strict=False)]
    return pa.table([pa.array(ids[doc[at]], pa.int64()), pa.array(hashes[doc[at]], pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "text_hash", "found"])


def _candidates(data, offs, found: list[bytes], block: int, window: int):
    """Words' rows and, for windows that hold a found block, their starts and 128-bit hashes."""
    s, e, row = word_spans(data, offs)
    h = hash_words(data, s, e)
    at = same_row(row, block)
    tag = _tag(window_hash(h, block, 71)[at])
    hit = np.zeros(len(row) + window, np.int64)
    bounds = np.searchsorted(row[at], np.arange(len(found) + 1))
    for i, raw in enumerate(found):
        a, b = bounds[i], bounds[i + 1]
        hit[at[a:b]] = np.isin(tag[a:b], np.frombuffer(raw, "<u8"))
    starts = same_row(row, window)
    sums = np.concatenate([[0], np.cumsum(hit)])
    starts = starts[sums[starts + window - block + 1] > sums[starts]]
    return s, e, row, starts, window_hash(h, window, 101)[starts], window_hash(h, window, 103)[starts]


def _windows(block: int, window: int, buckets: int):
    """Step 2: mail of the windows that hold a hit."""

    def post(batches):
        for chunk, lo, hi, data, offs, batch in _chunks(batches):
            ids, hashes = _chunk(batch, lo, hi)
            _, _, row, starts, a, b = _candidates(data, offs, batch.column("found").slice(lo, hi - lo).to_pylist(), block, window)
            doc = row[starts]
            order = np.lexsort((ids[doc], b, a))
            if not len(order):
                continue
            new = np.ones(len(order), bool)
            new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
            first, run = np.flatnonzero(new), np.cumsum(new) - 1
            late = ids[doc[order]] > ids[doc[order[first]]][run]
            # Equal ids in one chunk: each row needs its own answer.
            twin = ~late & (doc[order] != doc[order[first]][run])
            one = np.concatenate([order[first], order[twin]])
            body = np.zeros(len(one), _WINDOW)
            body["a"], body["b"], body["id"], body["doc"] = a[one], b[one], ids[doc[one]], doc[one]
            yield _mail(chunk, buckets, a[one], body, ids, hashes, _hits(a[order][late], doc[order][late]))

    return post


def _match_windows(group: pa.Table) -> pa.Table:
    chunks, bodies, notes = _unpack(group)
    src = np.repeat(np.arange(len(chunks)), [len(b) // _WINDOW.itemsize for b in bodies])
    entry = np.frombuffer(b"".join(bodies), _WINDOW)
    if not len(entry):
        return _replies(chunks, src, np.zeros(0, _HIT), notes)
    order = np.lexsort((entry["b"], entry["a"]))
    entry, src = entry[order], src[order]
    new = np.ones(len(entry), bool)
    new[1:] = (entry["a"][1:] != entry["a"][:-1]) | (entry["b"][1:] != entry["b"][:-1])
    first, run = np.flatnonzero(new), np.cumsum(new) - 1
    late = entry["id"] > np.minimum.reduceat(entry["id"], first)[run]
    return _replies(chunks, src[late], _hits(entry["a"][late], entry["doc"][late]), notes)


def covered_words(data, offs, found: list[bytes], block: int, window: int):
    """Spans and rows of the words, and which of them a found window covers."""
    s, e, row = word_spans(data, offs)
    starts = same_row(row, window)
    a = window_hash(hash_words(data, s, e), window, 101)[starts]
    bounds = np.searchsorted(row[starts], np.arange(len(found) + 1))
    step = np.zeros(len(row) + window + 1, np.int64)
    for i, raw in enumerate(found):
        if raw:
            lo, hi = bounds[i], bounds[i + 1]
            dup = starts[lo:hi][np.isin(a[lo:hi], np.frombuffer(raw, "<u8"))]
            step[dup] += 1
            step[dup + window] -= 1
    return s, e, row, np.cumsum(step)[: len(row)] > 0


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(
        F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("doc_id"),
        F.col(key).cast("long").alias("own"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
        F.col(text).alias("text"),
    )


def _gather(mail: DataFrame, match, name: str) -> DataFrame:
    replies = mail.groupBy("bucket").applyInArrow(match, _REPLY)
    found = replies.groupBy("chunk").applyInArrow(_assemble, _ANSWER)
    # Repeated rows have the same answer.
    return materialize(found.groupBy("doc_id", "text_hash").agg(F.first("found").alias("found")), name)


def _tasks(entries: int) -> int:
    return max(1, -(-int(entries) // ENTRIES_PER_TASK))


def repeated_windows(df: DataFrame, *, key: str = "doc_id", text: str = "text", block: int = 7) -> DataFrame:
    """(doc_id, text_hash, found) of the documents with windows that start in a smaller
    document; ``found`` has those windows' hashes. A null id is the largest long here."""
    tune(df.sparkSession)
    docs = _keyed(df, key, text)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # About six bytes a word.
    hits = _gather(docs.mapInArrow(_anchors(block, _tasks(int(size) // 6)), _MESSAGE), _match_anchors, "anchors")
    # A window is four times an anchor's entry, and a hit brings one or a few of them.
    found = hits.agg(F.coalesce(F.sum(F.octet_length("found")), F.lit(0))).first()[0] // 8
    near = docs.join(hits, ["doc_id", "text_hash"]).mapInArrow(_windows(block, 2 * block - 1, _tasks(4 * int(found))), _MESSAGE)
    found = _gather(near, _match_windows, "windows")
    discard(hits)
    return found


def _digest(batches):
    for batch in batches:
        for lo, hi, data, offs in text_chunks(batch.column("text")):
            found = batch.column("found").slice(lo, hi - lo).to_pylist()
            s, e, row, gone = covered_words(data, offs, found, 7, 13) if any(found) else (*word_spans(data, offs), None)
            bounds = np.searchsorted(row, np.arange(hi - lo + 1)).tolist()
            raw, at = data.tobytes(), offs.tolist()
            removed, sha = [], []
            for i in range(hi - lo):
                words = raw[at[i] : at[i + 1]].split()
                if gone is not None:
                    g = gone[bounds[i] : bounds[i + 1]]
                    removed.append(int(g.sum()))
                    if removed[-1]:
                        words = [w for w, x in zip(words, g.tolist(), strict=True) if not x]
                else:
                    removed.append(0)
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(bounds), pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )


def substring_digest(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (windows of 13 words)."""
    found = repeated_windows(df, key=key, text=text)
    docs = _keyed(df, key, text).join(found, ["doc_id", "text_hash"], "left")
    return docs.select(F.col("own").alias("doc_id"), "text", "found").mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _cut(batches):
    for batch in batches:
        texts = batch.column("__ql_text")
        out = texts.to_pylist()
        for lo, hi, data, offs in text_chunks(texts):
            found = batch.column("__ql_found").slice(lo, hi - lo).to_pylist()
            if not any(found):
                continue
            s, e, row, gone = covered_words(data, offs, found, 7, 13)
            raw = data.tobytes()
            for i in np.unique(row[gone]).tolist():
                own = np.flatnonzero(row == i)
                keep = own[~gone[own]]
                # White space before a kept word stays with it.
                before = np.concatenate([[offs[i]], e[own[:-1]]])[~gone[own]]
                out[lo + i] = b"".join(raw[a:b] for a, b in zip(before.tolist(), e[keep].tolist(), strict=True)).strip().decode()
        yield batch.set_column(batch.schema.get_field_index("__ql_text"), "__ql_text", pa.array(out, texts.type)).drop_columns(["__ql_found"])


def remove_repeats(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without their repeated passages; one of which nothing is left goes. n_chars is counted anew."""
    found = repeated_windows(df, key=key, text=text).select(F.col("doc_id").alias("__ql_id"), F.col("text_hash").alias("__ql_hash"), F.col("found").alias("__ql_found"))
    same = (F.coalesce(F.col(key).cast("long"), F.lit(_LAST)) == F.col("__ql_id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("__ql_hash"))
    docs = df.join(found, same, "left").select(*[df[c] for c in df.columns if c != text], df[text].alias("__ql_text"), "__ql_found")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop("__ql_found").schema)
    out = docs.mapInArrow(_cut, schema)
    out = out.where(F.col("__ql_text").isNull() | (F.col("__ql_text") != ""))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.length("__ql_text").cast(df.schema["n_chars"].dataType))
    return out.withColumnRenamed("__ql_text", text).select(*df.columns)
