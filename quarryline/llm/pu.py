"""Quality classifier by positive-unlabelled learning (operator 8).

Positives are the trusted labels; everything else is web text of unknown quality. A small
network is fitted by the non-negative unbiased risk: with class prior p, the risk is
p * (positives as positive) + max(0, unlabelled as negative - p * positives as negative),
and when a batch's negative part falls below zero its gradient is turned, which stops the
network from learning the unlabelled copies of the positives as negatives.

The prior is estimated from positives and unlabelled rows alone, by the best bin: a first net
is fitted on half of each, and over the thresholds of its scores on the other halves, the
share of unlabelled rows above is divided by that of positives above; the least such ratio,
with a bound for its error, is the prior. Labels of the other kind are not used. The fit takes
at most ``sample`` rows of positives, drawn by the smallest id hashes; the unlabelled side of the
risk and of the prior is all rows: every task trains on its own from the same net, and the nets
are averaged by rows. The features come from whole texts, and every row is scored.

Features are shapes of the text (lengths, symbols, case, repeats, lines) and the words
themselves, as shares of ``WORD_BINS`` hashed classes of words, scaled by the positives' median
and spread and squashed, so an extreme value cannot run away.

Defined results: null and empty texts are scored as texts without words; with no positives
every score is the prior (0.5 if unknown); repeated rows are scored alike; several labels
of one id count by their mean; an empty table gives no rows; texts of any length are
read whole. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import materialize, text_chunks, tune
from quarryline.llm.lines import Texts

SAMPLE_ROWS = 20_000
#: Classes of words by hash; the upper bits of a word's hash choose.
WORD_BINS = 64
NAMES = ("log_words", "symbols", "dup_lines", "repeats", "upper", "exclaims", "pipes", "digits", "word_length", "line_words", "stops", "commas", "long_words", "distinct")


def shape_features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    t = Texts(data, offs)

    def per(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[offs[1:]] - sums[offs[:-1]]

    words, bytes_ = t.n_words(), np.maximum(1, np.diff(offs))
    w, lines = np.maximum(1, words), np.maximum(1, t.count(t.lrow[t.lwords > 0]))
    order = np.lexsort((t.h, t.row))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = (t.h[order[1:]] != t.h[order[:-1]]) | (t.row[order[1:]] != t.row[order[:-1]])
    cols = (
        np.log1p(words), t.n_symbols() / w, t.n_dup_lines() / lines, t.n_repeat_words() / w, per((data >= 65) & (data <= 90)) / bytes_,
        per(data == 33) / w, per(data == 124) / w, per((data >= 48) & (data <= 57)) / w, t.word_chars() / w, words / lines,
        per(data == 46) / w, per(data == 44) / w, t.count(t.row[t.e - t.s > 15]) / w, t.count(t.row[order[new]]) / w,
    )
    bins = np.bincount(t.row * WORD_BINS + (t.h >> np.uint64(58)).astype(np.int64), minlength=t.n * WORD_BINS).reshape(t.n, WORD_BINS)
    return np.concatenate([np.stack(cols, 1), np.sqrt(bins / w[:, None])], 1).astype(np.float32)


def _features(batches):
    for batch in batches:
        for lo, hi, data, offs in text_chunks(batch.column("text")):
            x = shape_features(data, offs)
            cuts = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(cuts, pa.array(x.ravel()))], names=["doc_id", "x"])


class PuNet:
    """One hidden layer over scaled features."""

    def __init__(self, x: np.ndarray, hidden: int = 16, seed: int = 8):
        rng = np.random.default_rng(seed)
        self.mid = np.median(x, 0)
        self.spread = np.maximum(np.percentile(x, 95, 0) - np.percentile(x, 5, 0), 1e-2)
        # The words' classes weigh more the more positives there are to learn them from.
        self.weight = np.ones(x.shape[1])
        self.weight[len(NAMES) :] = min(0.5, (len(x) / SAMPLE_ROWS) ** 0.5)
        d = 2 * x.shape[1]
        self.p = [rng.standard_normal((d, hidden)) * d**-0.5, np.zeros(hidden), rng.standard_normal(hidden) * hidden**-0.5, np.zeros(1)]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mid) / self.spread * self.weight
        return np.concatenate([np.tanh(z), np.tanh(z / 4)], 1)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.p[0] + self.p[1])
        return h, h @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(self.scaled(x.astype(np.float64)))[1], -50, 50)))

    def copy(self) -> PuNet:
        return self.filled(np.concatenate([p.ravel() for p in self.p]))

    def filled(self, flat: np.ndarray) -> PuNet:
        """The same scaling with other weights."""
        out, at = object.__new__(PuNet), 0
        out.mid, out.spread, out.weight, out.p = self.mid, self.spread, self.weight, []
        for p in self.p:
            out.p.append(flat[at : at + p.size].reshape(p.shape).copy())
            at += p.size
        return out

    def gradient(self, z: np.ndarray, h: np.ndarray, dg: np.ndarray) -> list[np.ndarray]:
        da = np.outer(dg, self.p[2]) * (1 - h * h)
        return [z.T @ da, da.sum(0), h.T @ dg, np.array([dg.sum()])]


def _descend(net: PuNet, zp: np.ndarray, parts, prior: float, rate: float, rng: np.random.Generator, batch: int) -> PuNet:
    """Adam on the non-negative risk under the logistic loss, one step for each array of unlabelled rows in ``parts``."""
    m, v = [np.zeros_like(p) for p in net.p], [np.zeros_like(p) for p in net.p]
    for t, u in enumerate(parts, 1):
        p = zp[rng.integers(0, len(zp), min(batch, len(zp)))]
        hp, gp = net.forward(p)
        hu, gu = net.forward(u)
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        grad_neg = [a + b for a, b in zip(net.gradient(u, hu, su / len(u)), net.gradient(p, hp, -prior * sp / len(p)), strict=True)]
        if negative >= 0:
            grad = [a + b for a, b in zip(net.gradient(p, hp, prior * (sp - 1) / len(p)), grad_neg, strict=True)]
        else:
            grad = [-g for g in grad_neg]
        for k, g in enumerate(grad):
            g = g + 1e-4 * net.p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            net.p[k] = net.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, epochs: int = 40, batch: int = 2048, rate: float = 0.01, seed: int = 8) -> PuNet:
    """A net fitted in one place."""
    net, rng = PuNet(positive.astype(np.float64), seed=seed), np.random.default_rng(seed)
    zp, zu = net.scaled(positive.astype(np.float64)), net.scaled(unlabelled.astype(np.float64))
    parts = (zu[rows] for _ in range(epochs) for rows in np.array_split(rng.permutation(len(zu)), -(-len(zu) // batch)))
    return _descend(net, zp, parts, prior, rate, rng, batch)


def _rows_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten(), np.float32).reshape(batch.num_rows, -1)


def _trained(sent, prior: float, steps: int, batch: int, rate: float, seed: int):
    """A task's net after one pass over its rows, or ``steps`` steps if these are more; its weights times its rows."""

    def run(batches):
        net, zp = sent.value
        rng, n = np.random.default_rng(seed), [0]

        def parts():
            wait, held, done = np.zeros((0, zp.shape[1])), [], 0
            for b in batches:
                n[0] += b.num_rows
                wait = np.concatenate([wait, net.scaled(_rows_of(b).astype(np.float64))])
                while len(wait) >= batch:
                    u, wait = wait[:batch], wait[batch:]
                    if len(held) < steps:
                        held.append(u)
                    done += 1
                    yield u
            if len(wait):
                held.append(wait)
                done += 1
                yield wait
            again = np.concatenate(held) if held else wait
            while len(again) and done < steps:
                for rows in np.array_split(rng.permutation(len(again)), -(-len(again) // batch)):
                    done += 1
                    yield again[rows]

        fitted = _descend(net.copy(), zp, parts(), prior, rate, rng, batch)
        if n[0]:
            flat = np.concatenate([p.ravel() for p in fitted.p]) * n[0]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 64], pa.int32()), pa.array([n[0]], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["salt", "n", "weights"])

    return run


def _added(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(w) for w in group.column("weights").to_pylist())
    return pa.table({"salt": group.column("salt")[:1], "n": pa.array([sum(group.column("n").to_pylist())], pa.int64()), "weights": pa.array([total.tobytes()], pa.binary())})


def fit_all(rows: DataFrame, positive: np.ndarray, prior: float, *, rounds: int = 5, steps: int = 80, batch: int = 2048, rate: float = 0.01, seed: int = 8) -> PuNet:
    """A net fitted to the positives and to every row of ``rows`` (x): in each round all tasks start from one net, and
    their nets are averaged by rows."""
    net = PuNet(positive.astype(np.float64), seed=seed)
    zp, kind = net.scaled(positive.astype(np.float64)), "salt int, n long, weights binary"
    for r in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast((net, zp))  # the positives are at most the documented sample
        told = rows.select("x").mapInArrow(_trained(sent, prior, steps, batch, rate, seed + r), kind).groupBy("salt").applyInArrow(_added, kind).orderBy("salt").toArrow()
        sent.unpersist()
        if told.num_rows:
            net = net.filled(sum(np.frombuffer(w) for w in told.column("weights").to_pylist()) / sum(told.column("n").to_pylist()))
    return net


def _best_bin(above: list[np.ndarray], n: tuple[int, int]) -> float:
    slack = np.sqrt(np.log(40) / 2) * (n[0] ** -0.5 + n[1] ** -0.5)
    best = int(np.argmin((above[1] + slack) / above[0]))
    return float(min(0.95, max(0.05, above[1][best] / above[0][best])))


def _cuts(positive: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(positive, np.linspace(0.0, 0.95, 96)))


def _share_above(scores: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return 1 - np.searchsorted(np.sort(scores), cuts, "left") / len(scores)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled rows, from a classifier's scores of both: the best bin's ratio, error included."""
    cuts = _cuts(positive)
    return _best_bin([_share_above(s, cuts) for s in (positive, unlabelled)], (len(positive), len(unlabelled)))


def prior_of(rows: DataFrame, positive: np.ndarray) -> float:
    """The prior from half of the positives and of all rows for a first net, and its scores of the other halves."""
    side = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    net = fit_all(rows.where(side == 0), positive[::2], 0.5, rounds=2, steps=50)
    mine = net.score(positive[1::2])
    cuts = _cuts(mine)

    def counted(batches):
        above, n = np.zeros(len(cuts), np.int64), 0
        for b in batches:
            scores = np.sort(net.score(_rows_of(b)))
            above += len(scores) - np.searchsorted(scores, cuts, "left")
            n += len(scores)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts) + 1, dtype=np.int32)), pa.array([*above.tolist(), n], pa.int64())], names=["cut", "n"])

    found = {r.cut: r.n for r in rows.where(side == 1).select("x").mapInArrow(counted, "cut int, n long").groupBy("cut").agg(F.sum("n").alias("n")).collect()}
    total = found.get(len(cuts), 0)
    return _best_bin([_share_above(mine, cuts), np.array([found[i] for i in range(len(cuts))]) / total], (len(mine), total)) if total else 0.5


def _scorer(net: PuNet | None, prior: float):
    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), np.float32).reshape(batch.num_rows, -1)
            y = net.score(x) if net is not None and len(x) else np.full(len(x), prior)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(y.astype(np.float64))], names=["doc_id", "score"])

    return run


def fold_of(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4


def quality_scores(df: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", learn: Column | None = None, sample: int = SAMPLE_ROWS, prior: float | None = None) -> DataFrame:
    """Per row: doc_id and score in [0, 1]. ``learn`` says which labels may be used."""
    tune(df.sparkSession)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(docs.mapInArrow(_features, "doc_id long, x array<float>"), "features")
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    known = known.where(learn) if learn is not None else known
    known = known.groupBy(F.col(key).cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).alias("good"))
    known = known.where("good").join(rows, "doc_id")

    def some(part: DataFrame) -> np.ndarray:
        """Rows of the smallest id hashes; about that many leave the tasks, whatever their number."""
        part = part.where(F.col("doc_id").isNotNull()).withColumn("h", F.xxhash64("doc_id"))
        n = part.count()
        if n > 2 * sample:
            part = part.where(F.col("h") < int((1 << 64) * 1.2 * sample / n) - (1 << 63))
        found = part.orderBy("h", "doc_id").limit(sample).select("x").toArrow().column("x")
        return np.asarray(found.combine_chunks().flatten(), np.float32).reshape(len(found), -1) if len(found) else np.zeros((0, len(NAMES) + WORD_BINS), np.float32)

    good = some(known)
    if prior is None:
        prior = prior_of(rows, good) if len(good) > 1 else 0.5
    net = fit_all(rows, good, prior) if len(good) else None
    return rows.mapInArrow(_scorer(net, prior), "doc_id long, score double")
