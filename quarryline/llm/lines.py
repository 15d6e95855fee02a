"""Quality rules with cross-document line frequency (operator 5).

One pass over the texts counts the base figures and hashes each distinct normalised line
(its words, ASCII lower case, one space between). Lines are counted by distinct document
within a host; rows of one text are one document. A line's limit is ``share`` of its host's
documents, but at least ``least_docs`` and at most ``max_docs`` of them, so that the rule acts
in small hosts and in large ones. A line above its limit is boilerplate: by the rule, the
host's first document that has it keeps it as the corpus's one copy, and it is removed from
all others. A document that keeps less than ``min_left`` of its words is rejected as
depleted, like one that fails the base rules.

Defined results: null text has no words and fails the base rules; null hosts form a host of
their own; a null id comes before all others; rows with equal id and text share one verdict;
an empty table gives no rows; a text or a line of any length is measured whole. Columns
other than those named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import flat_text, hash_words, lower_ascii, materialize, mix, same_row, text_chunks, tune, window_hash, word_spans

_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _earlier(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether an equal value stands earlier in the same row."""
    order = np.lexsort((np.arange(len(row)), value, row))
    again = np.zeros(len(row), bool)
    if len(row) > 1:
        a, b = order[:-1], order[1:]
        again[b] = (row[a] == row[b]) & (value[a] == value[b])
    return again


def line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every line; rows without bytes have none."""
    full = np.flatnonzero(offs[1:] > offs[:-1])
    cut = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offs[:-1][full], cut + 1]))
    end = np.sort(np.concatenate([cut, offs[1:][full]]))
    # A text's last line may be empty and start where the next text does, so rows are counted off.
    breaks = np.searchsorted(cut, offs[1:][full]) - np.searchsorted(cut, offs[:-1][full])
    row = np.repeat(full, breaks + 1)
    return start, end, row


class Texts:
    """Words, lines and base figures of a run of texts."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs, self.n = data, offs, len(offs) - 1
        self.s, self.e, self.row = word_spans(data, offs)
        self.h = hash_words(data, self.s, self.e)
        self.ls, self.le, self.lrow = line_spans(data, offs)
        first = np.searchsorted(self.s, self.ls, "left")
        self.lwords = np.searchsorted(self.s, self.le, "left") - first
        self.lfirst = first

    def count(self, where: np.ndarray) -> np.ndarray:
        return np.bincount(where, minlength=self.n).astype(np.int64)

    def n_words(self) -> np.ndarray:
        return self.count(self.row)

    def word_chars(self) -> np.ndarray:
        points = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        return np.bincount(self.row, points[self.e] - points[self.s], self.n).astype(np.int64)

    def n_symbols(self) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(_SYMBOL[self.data])])
        return (sums[self.offs[1:]] - sums[self.offs[:-1]]).astype(np.int64)

    def n_dup_lines(self) -> np.ndarray:
        some = self.lwords > 0
        row = self.lrow[some]
        return self.count(row[_earlier(row, hash_words(self.data, self.ls[some], self.le[some]))])

    def n_repeat_words(self) -> np.ndarray:
        at = same_row(self.row, 3)
        value, row = window_hash(self.h, 3, 53)[at], self.row[at]
        order = np.lexsort((value, row))
        hit = np.zeros(len(self.row) + 3, bool)
        if len(order) > 1:
            a, b = order[:-1], order[1:]
            same = (row[a] == row[b]) & (value[a] == value[b])
            for start in (at[a[same]], at[b[same]]):
                for i in range(3):
                    hit[start + i] = True
        return self.count(self.row[hit[: len(self.row)]])

    def line_keys(self) -> np.ndarray:
        """Hash of each line's words in lower case; 0 for a line without words."""
        lower = hash_words(lower_ascii(self.data), self.s, self.e)
        out = np.zeros(len(self.ls), _U)
        some = np.flatnonzero(self.lwords > 0)
        if len(some):
            place = np.arange(len(lower)) - np.repeat(self.lfirst[some], self.lwords[some])
            out[some] = mix(np.add.reduceat(mix(lower + place.astype(_U) * _U(0x9E3779B97F4A7C15)), self.lfirst[some]))
        return out


def _lists(values: np.ndarray, row: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    offs = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))


def _measure(batches):
    for batch in batches:
        for lo, hi, data, offs in text_chunks(batch.column("text")):
            t = Texts(data, offs)
            some = t.lwords > 0
            key, row, words = t.line_keys()[some], t.lrow[some], t.lwords[some]
            # Distinct lines of a text, with the words of all their places.
            order = np.lexsort((key, row))
            key, row, words = key[order], row[order], words[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            total = np.add.reduceat(words, first) if len(first) else words
            kept = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [
                    *[kept.column(c) for c in ("doc_id", "host", "text_hash")],
                    *[pa.array(f) for f in (t.n_words(), t.word_chars(), t.n_symbols(), t.n_dup_lines(), t.n_repeat_words())],
                    _lists(key[first].view(np.int64), row[first], t.n, pa.int64()),
                    _lists(total, row[first], t.n, pa.int64()),
                ],
                names=["doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"],
            )


def measure_texts(df: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The base figures and distinct lines of every row, written and read back."""
    tune(df.sparkSession)
    docs = df.select(
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
        F.col(text).alias("text"),
    )
    return materialize(docs.mapInArrow(_measure, f"doc_id long, host string, text_hash long, {_BASE}, lines array<long>, line_words array<long>"), "lines")


def frequent_lines(measured: DataFrame, max_docs: int, least_docs: int, share: float) -> DataFrame:
    """(host, line, first_doc) of the lines above their host's limit."""
    rows = measured.select("host", "text_hash", "doc_id", F.explode("lines").alias("line"))
    texts = rows.groupBy("host", "line", "text_hash").agg(F.min("doc_id").alias("doc_id"), F.max(F.col("doc_id").isNull()).alias("none"))
    lines = texts.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("none").alias("none"))
    hosts = measured.select("host", "text_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    limit = F.least(F.lit(float(max_docs)), F.greatest(F.lit(float(least_docs)), F.lit(share) * F.col("docs")))
    lines = lines.where(F.col("n") > min(max_docs, least_docs)).join(hosts, "host").where(F.col("n") > limit)
    return lines.select("host", "line", F.when(~F.col("none"), F.col("first")).alias("first_doc"))


def line_verdicts(measured: DataFrame, *, max_docs: int = 100, least_docs: int = 5, share: float = 0.1, min_left: float = 0.3) -> DataFrame:
    """Measured rows with removed (line hashes), n_removed_words, base_failed and kept."""
    often = frequent_lines(measured, max_docs, least_docs, share)
    rows = measured.select("host", "doc_id", "text_hash", F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
    rows = rows.select("host", "doc_id", "text_hash", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    gone = rows.join(often, ["host", "line"]).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    gone = gone.groupBy("host", "doc_id", "text_hash", "line").agg(F.max("words").alias("words"))
    gone = gone.groupBy("host", "doc_id", "text_hash").agg(F.collect_list("line").alias("removed"), F.sum("words").alias("n_removed_words"))
    gone = gone.select(*[F.col(c).alias(f"g_{c}") for c in ("host", "doc_id", "text_hash")], "removed", "n_removed_words")
    same = (F.col("host") == F.col("g_host")) & F.col("doc_id").eqNullSafe(F.col("g_doc_id")) & (F.col("text_hash") == F.col("g_text_hash"))
    out = measured.drop("lines", "line_words").join(gone, same, "left").drop("g_host", "g_doc_id", "g_text_hash")
    out = out.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words") >= F.lit(min_left) * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & left)


def _strip(batches):
    for batch in batches:
        texts, removed = batch.column("__ql_text"), batch.column("__ql_removed").to_pylist()
        out = texts.to_pylist()
        hit = [i for i, r in enumerate(removed) if r and out[i]]
        for i in hit:
            data, offs = flat_text(pa.array([out[i]]))
            t = Texts(data, offs)
            go = np.isin(t.line_keys().view(np.int64), np.array(removed[i], np.int64)) & (t.lwords > 0)
            raw = out[i].encode()
            out[i] = b"\n".join(raw[a:b] for a, b, g in zip(t.ls.tolist(), t.le.tolist(), go.tolist(), strict=True) if not g).decode()
        yield batch.set_column(batch.schema.get_field_index("__ql_text"), "__ql_text", pa.array(out, texts.type)).drop_columns(["__ql_removed"])


def apply_line_rules(df: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The documents that are kept, without their removed lines; columns as given, n_chars counted anew."""
    verdicts = line_verdicts(measure_texts(df, key=key, text=text, host=host), **limits)
    verdicts = verdicts.where("kept").groupBy(F.col("doc_id").alias("__ql_id"), F.col("host").alias("__ql_host"), F.col("text_hash").alias("__ql_hash")).agg(F.first("removed").alias("__ql_removed"))
    same = F.col(key).eqNullSafe(F.col("__ql_id")) & (F.col("__ql_host") == F.coalesce(F.col(host).cast("string"), F.lit(""))) & (F.col("__ql_hash") == F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    kept = df.join(verdicts, same).select(*[df[c] for c in df.columns if c != text], df[text].alias("__ql_text"), "__ql_removed")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("__ql_removed").schema)
    out = kept.mapInArrow(_strip, schema)
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.length("__ql_text").cast(df.schema["n_chars"].dataType))
    return out.withColumnRenamed("__ql_text", text).select(*df.columns)
