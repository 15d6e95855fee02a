"""Language identification by interpolated Kneser-Ney character models (operator 12).

A text is its letters in lower case, everything between words one space. From labelled rows,
the 4-grams of characters are counted per language in Spark; the lower orders of Kneser-Ney are
counts of their types, so the whole model follows from that table. Its n-grams are kept as
sorted arrays of 64-bit hashes, one array for all languages with a column of log probabilities
for each, so one look-up serves every language; an n-gram that is not there costs the weight
its context leaves and is looked up one order lower. The language with the least cross-entropy
per character is the prediction.

The fit reads about ``sample_rows`` labelled rows a language, drawn by id hashes; a fifth of them
is not counted but calibrates: the score is a tempered posterior over the languages, with
temperature and growth by length of the least log loss, and a text whose cross-entropy lies above
what nearly all texts of its language have is rejected, which halves its score. The model is
broadcast; it takes at most ``MODEL_BYTES`` by construction, as the most frequent n-grams of each
language are kept that fit. The ``MAX_LANGS`` most frequent labels are learned.

Defined results: ``und``, score 0 and null cross-entropy for null texts, for texts without a
letter and where nothing could be learned; ties go to the smaller language name; repeated rows
are scored alike; a null id is never learned from nor held out; texts are read whole, whatever
their length; an empty table gives no rows. Columns other than id, text and language are not read.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import materialize, mix, tune

ORDER = 4
#: Learned rows of a language, about; labels of one block; and the model's bytes at most.
SAMPLE_ROWS, BLOCK_LANGS, MODEL_BYTES = 10_000, 128, 128 << 20
#: Cross-entropies that calibrate, at most: rows times labels.
CALIBRATING = 1 << 25
#: n-grams of a language at most.
GRAMS = 1 << 17
#: Characters of text that are handled at once; a longer text is handled alone.
CHUNK_CHARS = 1 << 18
SPACE, UNKNOWN = 32, "und"
#: Share of a language's calibrating texts that lie below its limit of cross-entropy.
ACCEPTED = 0.995

_U = np.uint64
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], _U)
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def char_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, each after ORDER - 1 spaces, and the (texts + 1) offsets; a word ends with a space."""
    low = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low)) + 1
    codes = np.frombuffer(" ".join([*low, ""]).encode("utf-32-le"), np.uint32)
    letter = letter_table()[codes]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    at = np.flatnonzero(kept)
    row = np.repeat(np.arange(len(low)), sizes)[at]
    counts = np.bincount(row, minlength=len(low))
    offs = np.concatenate([[0], np.cumsum(counts + ORDER - 1)])
    out = np.full(offs[-1], SPACE, np.uint32)
    out[np.arange(len(at)) + (ORDER - 1) * (row + 1)] = np.where(letter[at], codes[at], SPACE)
    return out, offs


def places(offs: np.ndarray) -> np.ndarray:
    """Positions of the characters that are predicted: all but the leading spaces."""
    keep = np.ones(offs[-1], bool)
    for i in range(ORDER - 1):
        keep[offs[:-1] + i] = False
    return np.flatnonzero(keep)


def gram_keys(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each row of n codes, given column by column; the last character's multiplier is the same for any n."""
    out = np.full(len(columns[0]), len(columns), _U)
    for code, place in zip(reversed(columns), _PLACES, strict=False):
        out += (code.astype(_U) + _U(1)) * place
    return mix(out)


class HashArray:
    """Sorted hashes with an index by their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = _U(64 - max(1, int(np.ceil(np.log2(len(keys) + 1)))))
        self.start = np.searchsorted(keys >> self.shift, np.arange((1 << int(64 - self.shift)) + 1, dtype=_U)).astype(np.int32)
        self.longest = int(np.diff(self.start).max()) if len(keys) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        bucket = (keys >> self.shift).astype(np.int64)
        at, end, who = self.start[bucket].astype(np.int64), self.start[bucket + 1], np.arange(len(keys))
        for _ in range(self.longest):
            live = at < end
            at, end, who = at[live], end[live], who[live]
            if not len(who):
                break
            hit = self.keys[at] == keys[who]
            out[who[hit]] = at[hit]
            at, end, who = at[~hit] + 1, end[~hit], who[~hit]
        return out


class KneserNey:
    """Models of several languages over one set of n-grams, from (codes of ORDER-grams, counts) of each."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], alphabet: np.ndarray | None = None):
        own: list[list[tuple]] = []  # by language, then by order from ORDER down to 1: codes, counts
        for codes, counts in grams:
            levels = [(codes, counts.astype(np.float64))]
            while levels[-1][0].shape[1] > 1:
                shorter = levels[-1][0][:, 1:]
                _, first, types = np.unique(gram_keys(list(shorter.T)), return_index=True, return_counts=True)
                levels.append((shorter[first], types.astype(np.float64)))
            own.append(levels[::-1])
        self.tables, self.logp, self.contexts, self.left = [], [], [], []
        if alphabet is None:
            alphabet = np.unique(np.concatenate([x[0][0][:, 0] for x in own])) if own else np.zeros(0)
        below: np.ndarray | None = None
        for n in range(1, ORDER + 1):
            codes = np.concatenate([x[n - 1][0] for x in own])
            keys, first = np.unique(gram_keys(list(codes.T)), return_index=True)
            table, codes = HashArray(keys), codes[first]
            heads = gram_keys(list(codes[:, :-1].T)) if n > 1 else np.zeros(len(codes), _U)
            context = HashArray(np.unique(heads))
            where, tails = context.find(heads), self.tables[-1].find(gram_keys(list(codes[:, 1:].T))) if n > 1 else None
            prob, left = np.zeros((len(keys), len(own))), np.ones((len(context.keys), len(own)))
            for lang, levels in enumerate(own):
                mine, counts = levels[n - 1]
                at = table.find(gram_keys(list(mine.T)))
                ones, twos = (counts == 1).sum(), (counts == 2).sum()
                discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
                head = where[at]
                total, types = (np.bincount(head, w, len(context.keys)) for w in (counts, None))
                seen = total > 0
                left[seen, lang] = discount * types[seen] / total[seen]
                prob[at, lang] = np.maximum(counts - discount, 0) / total[head]
                lower = below[tails, lang] if n > 1 else 1 / (len(alphabet) + 1)
                prob[:, lang] += left[where, lang] * lower
            self.tables.append(table)
            self.contexts.append(context)
            self.logp.append(np.log(prob).astype(np.float32))
            self.left.append(np.log(left).astype(np.float32))
            below = prob
        #: An unseen character: what the lowest order leaves, spread over the alphabet and one more.
        self.unseen = self.left[0][0] - np.log(len(alphabet) + 1) if own and len(self.left[0]) else None

    def log_probability(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(positions, languages): log probability of the character at each place given those before it."""
        out = np.zeros((len(at), self.logp[0].shape[1]), np.float32)
        who = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            parts = [codes[at[who] - k] for k in range(n - 1, -1, -1)]
            found = self.tables[n - 1].find(gram_keys(parts))
            hit = found >= 0
            out[who[hit]] += self.logp[n - 1][found[hit]]
            who = who[~hit]
            if not len(who):
                return out
            if n > 1:
                context = self.contexts[n - 1].find(gram_keys([p[~hit] for p in parts[:-1]]))
                known = context >= 0
                out[who[known]] += self.left[n - 1][context[known]]
        out[who] += self.unseen
        return out

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, languages) nats per character, the characters and whether there is a letter."""
        codes, offs = char_codes(texts)
        at = places(offs)
        n = np.diff(offs) - (ORDER - 1)
        some = np.flatnonzero(n > 0)
        out = np.zeros((len(texts), self.logp[0].shape[1]))
        if len(some):
            lp = self.log_probability(codes, at)
            begins = np.concatenate([[0], np.cumsum(n[some])[:-1]])
            out[some] = -np.add.reduceat(lp, begins, axis=0, dtype=np.float64) / n[some, None]
        return out, n, n > 0


class Models:
    """Models of blocks of languages over the alphabet of all, which answer as one."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], size: int):
        alphabet = np.unique(np.concatenate([codes[:, -1] for codes, _ in grams])) if grams else np.zeros(0)
        self.blocks = [KneserNey(grams[lo : lo + size], alphabet) for lo in range(0, len(grams), size)]

    @property
    def learned(self) -> bool:
        return any(b.unseen is not None for b in self.blocks)

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [b.cross_entropy(texts) for b in self.blocks if b.unseen is not None]
        none = [np.full((len(texts), b.logp[0].shape[1]), np.inf) if b.unseen is None else None for b in self.blocks]
        found = iter(parts)
        return np.concatenate([next(found)[0] if n is None else n for n in none], axis=1), *parts[0][1:]


def _runs(texts: list[str], limit: int = CHUNK_CHARS):
    """(from, to) of runs of texts of at most ``limit`` characters, or one text."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _counted(batches):
    for batch in batches:
        langs, texts = np.array(batch.column("lang").to_pylist(), object), batch.column("text").to_pylist()
        for lang in dict.fromkeys(langs):
            own = [t for t, la in zip(texts, langs, strict=True) if la == lang]
            for lo, hi in _runs(own):
                codes, offs = char_codes(own[lo:hi])
                at = places(offs)
                if len(at):
                    parts = [codes[at - k] for k in range(ORDER - 1, -1, -1)]
                    _, first, n = np.unique(gram_keys(parts), return_index=True, return_counts=True)
                    high, low = (parts[i][first].astype(np.int64) << 21 | parts[i + 1][first] for i in (0, 2))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(high), pa.array(low), pa.array(n)], names=["lang", "a", "b", "n"])


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, a, b, n): the 4-grams of (lang, text), two codes of 21 bits in each of a and b."""
    return labelled.select("lang", "text").mapInArrow(_counted, "lang string, a long, b long, n long").groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, langs: list[str]) -> Models:
    size = len(langs) if len(langs) <= BLOCK_LANGS else BLOCK_LANGS // 8
    most = min(GRAMS, max(1, MODEL_BYTES // (4 * size * len(langs))))
    counts = materialize(gram_counts(labelled), "grams")
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "a", "b"))
    rows = counts.withColumn("place", first).where(F.col("place") <= most).drop("place").toArrow().sort_by("lang")
    lang, a, b, n = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "a", "b", "n"))
    codes = np.stack([a >> 21, a & 0x1FFFFF, b >> 21, b & 0x1FFFFF], 1).astype(np.uint32)
    lang = lang.astype(str)
    cuts = [slice(np.searchsorted(lang, x, "left"), np.searchsorted(lang, x, "right")) for x in langs]
    return Models([(codes[c], n[c]) for c in cuts], size)


class Calibration:
    """Temperature and power of length of the least log loss, and the limit of cross-entropy of each language."""

    def __init__(self, entropy: np.ndarray, n: np.ndarray, truth: np.ndarray):
        self.power, self.heat, self.limit = 0.5, 1.0, np.full(entropy.shape[1], np.inf)
        if not len(n):
            return
        loss = {}
        for power in (0.0, 0.5, 1.0):
            for heat in 2.0 ** np.arange(-6, 7):
                p = self._posterior(entropy, n, power, heat)[np.arange(len(n)), truth]
                loss[power, heat] = -np.log(np.maximum(p, 1e-12)).mean() + 1e-6 * heat
        self.power, self.heat = min(loss, key=loss.get)
        best = entropy.argmin(1)
        for lang in range(entropy.shape[1]):
            right = (best == lang) & (truth == lang)
            if right.sum() >= 20:
                self.limit[lang] = np.quantile(entropy[right, lang], ACCEPTED)

    @staticmethod
    def _posterior(entropy, n, power, heat):
        z = -heat * (np.maximum(n, 1)[:, None] ** power) * (entropy - entropy.min(1, keepdims=True))
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)

    def __call__(self, entropy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, score and whether the text is rejected."""
        best = entropy.argmin(1)
        score = self._posterior(entropy, n, self.power, self.heat)[np.arange(len(n)), best]
        rejected = entropy[np.arange(len(n)), best] > self.limit[best]
        return best, np.where(rejected, score / 2, score), rejected


def _entropies(model, names: list[str]):
    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in _runs(texts):
                entropy, n, _ = model.value.cross_entropy(texts[lo:hi])
                part = batch.slice(lo, hi - lo)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, entropy.size + 1, entropy.shape[1], dtype=np.int32)), pa.array(entropy.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], flat, pa.array(n)], names=[*names, "entropy", "n"])

    return run


def _predicted(model, calibration, langs: list[str]):
    names = pa.array([*langs, UNKNOWN])

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in _runs(texts):
                entropy, n, some = model.value.cross_entropy(texts[lo:hi])
                best, score, rejected = calibration(entropy, n)
                least = entropy[np.arange(len(n)), best]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), names.take(pa.array(np.where(some, best, len(langs)))), pa.array(np.where(some, score, 0.0)), pa.array(least, mask=~some), pa.array(rejected & some)],
                    names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"],
                )

    return run


def identify_languages(df: DataFrame, *, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) of every row, learned from the rows where ``learn`` holds."""
    spark = df.sparkSession
    tune(spark)
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    labelled = df.where(learn & F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = labelled.groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()
    langs = sorted(r.lang for r in sizes)
    if langs:
        rates = F.broadcast(spark.createDataFrame([(r.lang, min(1.0, sample_rows / r.n)) for r in sizes], "lang string, rate double"))
        drawn = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), *[F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(1 << 30)).alias(f"u{i}") for i in (12, 13)])
        drawn = materialize(drawn.join(rates, "lang").where(F.col("u12") < F.col("rate") * (1 << 30)).drop("rate"), "labelled")
        model = fit(drawn.where("u13 % 5 > 0"), langs)
    if not langs or not model.learned:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(False).alias("rejected"))
    sent = spark.sparkContext.broadcast(model)
    held = drawn.where("u13 % 5 = 0")
    share = CALIBRATING / max(1, held.count() * len(langs))
    held = held.where(F.floor(F.col("u13") / 5) % 65536 < 65536 * share) if share < 1 else held
    held = held.select("lang", "text").mapInArrow(_entropies(sent, ["lang"]), "lang string, entropy array<double>, n long").where("n > 0").toArrow()
    entropy = held.column("entropy").combine_chunks().flatten().to_numpy().reshape(-1, len(langs))
    truth = np.searchsorted(np.array(langs), np.array(held.column("lang").to_pylist(), dtype=object).astype(str)) if len(entropy) else np.zeros(0, int)
    calibration = Calibration(entropy, held.column("n").to_numpy(), truth)
    return docs.mapInArrow(_predicted(sent, calibration, langs), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, cross_entropy double, rejected boolean")
