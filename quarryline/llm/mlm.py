"""Masked pseudo-likelihood scoring with a bidirectional window network (operator 2).

A small numpy network predicts a word from the ``side`` words before and after it, the word
itself masked: embeddings of the window, one tanh layer, and a softmax in steps (group of
classes, class of words, then the word in it; a small vocabulary has one group). A document's score is the sum over all its words of the log
of that probability, each from both sides.

The vocabulary is the most frequent words of the whole corpus, lower-cased in ASCII, counted
in Spark; its size grows with the square root of the corpus's words, and the class tree with
it. A class of frequent words is small and one of rare words large, so that a position costs few
outputs; the other words' ids are a class of their own. Other words share hashed ids, and each has its own share of its id's
probability, by its count plus one; these counts stay a table, joined to the words of the documents. Training is data-parallel:
in each round every partition starts from the same weights, trains on its round's share of every document's
positions (those of rare classes wait until a batch has enough of their class, the partition's end at the latest), and the weights are averaged by tokens, in two grouped steps. The rounds' shares are
disjoint and together all positions: each is masked and predicted once. The driver holds
one network, of the vocabulary's size.

Defined results: a document without words (null or empty text) has 0 words and score 0.0;
repeated rows are scored alike; a text of any length is scored whole; an empty corpus gives no
rows. Other columns are not read. The weights depend on how the input is split into
partitions, as each trains on its own; the positions trained on do not.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import hash_words, lower_ascii, materialize, mix, text_chunks, tune, word_spans

_U = np.uint64
#: Words of a class of the output, and ids, of a small corpus.
WORDS = 64
VOCAB = WORDS * WORDS
#: Ids kept for words outside the vocabulary, by hash.
OTHERS = 64
#: Of a larger corpus: least words of a class, and its words for each square root of its first id.
LEAST_WORDS, STEEP = 32, 2.5
#: Outputs that are worked on at once: they stay in the cache.
OUTPUTS = 1 << 16
#: Targets of a class that a batch holds at least: others wait, as a step takes time for all weights of a class, and in a large
#: vocabulary most classes have a few targets in as many positions.
CLASS_ROWS = 32


@lru_cache(maxsize=8)
def class_cuts(size: int) -> np.ndarray:
    """First id of each class, and the end. Ids stand by falling frequency: if frequencies fall as in Zipf's law, a class's
    best size grows with the square root of its first one."""
    if size <= VOCAB:
        return np.arange(0, size + 1, WORDS)
    cuts, rare = [0], size - OTHERS
    while cuts[-1] < rare:
        cuts.append(min(rare, cuts[-1] + max(LEAST_WORDS, -(-int(STEEP * cuts[-1] ** 0.5) // 16) * 16)))
    return np.array([*cuts, size])


@lru_cache(maxsize=8)
def class_of(size: int) -> np.ndarray:
    """Class of each id."""
    return np.repeat(np.arange(len(class_cuts(size)) - 1), np.diff(class_cuts(size))).astype(np.uint16)


@lru_cache(maxsize=8)
def group_cuts(size: int) -> np.ndarray:
    """First class of each group, and the end: a small vocabulary has one group, a larger one about as many groups as a group
    has classes, and the other words' class is a group of its own."""
    classes = len(class_cuts(size)) - 1
    return np.array([0, classes]) if size <= VOCAB else np.array([*range(0, classes - 1, round(classes**0.5)), classes - 1, classes])


@lru_cache(maxsize=8)
def group_of(size: int) -> np.ndarray:
    """Group of each class."""
    return np.repeat(np.arange(len(group_cuts(size)) - 1), np.diff(group_cuts(size)))


def vocabulary_size(tokens: int) -> int:
    """Ids for a corpus of so many words: twice the square root, a multiple of 64."""
    return -(-max(VOCAB, int(2 * tokens**0.5)) // WORDS) * WORDS


@dataclass
class Network:
    """Weights: embeddings (the last row is the pad), hidden layer, groups, classes of each group, words of each class.

    The three output layers hold their biases as a last row, for a hidden value that is always 1. The
    blocks of a layer stand one after the other in it; ``block`` is the matrix of one.
    """

    e: np.ndarray
    w: np.ndarray
    b: np.ndarray
    gg: np.ndarray
    cg: np.ndarray
    oo: np.ndarray
    side: int

    @classmethod
    def fresh(cls, side: int = 2, width: int = 16, hidden: int = 24, seed: int = 2, size: int = VOCAB) -> Network:
        rng = np.random.default_rng(seed)

        def r(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        e, w = r(size + 1, width, scale=0.3), r(2 * side * width, hidden, scale=(2 * side * width) ** -0.5)
        outputs = [np.zeros((hidden + 1) * n, np.float32) for n in (len(group_cuts(size)) - 1, len(class_cuts(size)) - 1, size)]
        net = cls(e, w, np.zeros(hidden, np.float32), *outputs, side)
        for layer in (1, 2, 0):
            for k in range(len(net.cuts(layer)) - 1):
                net.block(layer, k)[:-1] = r(*net.block(layer, k)[:-1].shape, scale=0.1)
        return net

    cc = property(lambda self: np.hstack([self.block(1, g) for g in range(len(self.cuts(1)) - 1)]))
    c = property(lambda self: self.cc[:-1])
    cb = property(lambda self: self.cc[-1])
    o = property(lambda self: [self.block(2, k)[:-1] for k in range(self.classes)])
    ob = property(lambda self: [self.block(2, k)[-1] for k in range(self.classes)])
    classes = property(lambda self: len(self.cuts(2)) - 1)

    def cuts(self, layer: int) -> np.ndarray:
        """First output of each block of an output layer (0: groups, 1: classes, 2: words), and the end."""
        return (np.array([0, len(group_cuts(self.size)) - 1]), group_cuts(self.size), class_cuts(self.size))[layer]

    def block(self, layer: int, k: int) -> np.ndarray:
        """Weights of block ``k`` of an output layer."""
        rows, cuts = len(self.b) + 1, self.cuts(layer)
        return self.parts[3 + layer][rows * cuts[k] : rows * cuts[k + 1]].reshape(rows, -1)

    def blocks(self) -> list[list[np.ndarray]]:
        return [[self.block(layer, k) for k in range(len(self.cuts(layer)) - 1)] for layer in range(3)]

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.e, self.w, self.b, self.gg, self.cg, self.oo]

    @property
    def size(self) -> int:
        """Ids of words; the pad is the next one."""
        return len(self.e) - 1

    def window(self, x: np.ndarray) -> np.ndarray:
        """Embeddings of windows, one after the other."""
        return self.e.take(x, axis=0).reshape(len(x), -1)

    def hidden(self, v: np.ndarray) -> np.ndarray:
        """Hidden values of windows' embeddings, and the 1 for the biases."""
        h = np.ones((len(v), len(self.b) + 1), np.float32)
        z = v @ self.w
        z += self.b
        np.tanh(z, out=h[:, :-1])
        return h

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def filled(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for p in self.parts:
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Network(*out, side=self.side)


def windows(ids: np.ndarray, row: np.ndarray, side: int, pad: int = VOCAB) -> np.ndarray:
    """Ids around each position, nearest last on the left and first on the right; the pad outside its document."""
    n = len(ids)
    out = np.full((n, 2 * side), pad, np.int32)
    for col, d in enumerate([*range(-side, 0), *range(1, side + 1)]):
        if abs(d) < n:
            a, b = (slice(-d, n), slice(0, n + d)) if d < 0 else (slice(0, n - d), slice(d, n))
            same = row[a] == row[b]
            out[a, col] = np.where(same, ids[b], pad)
    return out


#: Sums of exponentials between these are right as they stand; otherwise each row's largest logit is taken off first.
LEAST_SUM, MOST_SUM = 1e-26, 1e26


@lru_cache(maxsize=4096)
def _ones(n: int) -> np.ndarray:
    return np.ones(n, np.float32)


def _softmax(h: np.ndarray, blocks: list, place: np.ndarray, z: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Exponentials of the outputs of rows of hidden values, by block, their sums by row, and the logits of the targets.

    ``blocks`` (weights, first row, last row) follow one another; their outputs stand together in ``z``, the targets' at ``place``.
    """
    parts, at = [], 0
    for weight, i, j in blocks:
        end = at + (j - i) * weight.shape[1]
        parts.append(np.matmul(h[i:j], weight, out=z[at:end].reshape(j - i, -1)))
        at = end
    logit, sums = z.take(place), np.empty(len(h), np.float32)
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
        for (_, i, j), part in zip(blocks, parts):
            np.matmul(part, _ones(part.shape[1]), out=sums[i:j])
    if not (sums.min() > LEAST_SUM and sums.max() < MOST_SUM):
        for (weight, i, j), part in zip(blocks, parts):
            np.matmul(h[i:j], weight, out=part)
            top = part.max(1)
            part -= top[:, None]
            logit[i:j] -= top
            np.exp(part, out=part)
            np.matmul(part, _ones(part.shape[1]), out=sums[i:j])
    return parts, sums, logit


class _Targets:
    """Positions by class, and what each output layer has to tell of them."""

    def __init__(self, net: Network, y: np.ndarray):
        cls = class_of(net.size)[y]
        self.order = np.argsort(cls, kind="stable")
        cls = cls.take(self.order)
        group, self.layers = group_of(net.size).take(cls), []
        for layer, (block, output) in enumerate(((np.zeros_like(group), group), (group, cls), (cls, y.take(self.order)))):
            cuts = net.cuts(layer)
            at = np.searchsorted(block, np.arange(len(cuts))).tolist()
            runs = [(k, at[k], at[k + 1]) for k in range(len(cuts) - 1) if at[k + 1] > at[k] and cuts[k + 1] - cuts[k] > 1]
            self.layers.append((runs, np.diff(cuts).take(block), output - cuts.take(block)))

    def bundles(self, layer: int, split: bool = False):
        """(runs, places of their targets, outputs) of neighbouring blocks, as many as fit in ``OUTPUTS``, one at least;
        with ``split`` a larger run comes in pieces."""
        runs, wide, target = self.layers[layer]
        if split:
            rows = np.maximum(1, OUTPUTS // wide)
            runs = [(k, a, min(a + int(rows[i]), j)) for k, i, j in runs for a in range(i, j, int(rows[i]))]
        at = 0
        while at < len(runs):
            to, n = at, 0
            while to < len(runs) and (to == at or runs[to][1] == runs[to - 1][2]):
                more = (runs[to][2] - runs[to][1]) * int(wide[runs[to][1]])
                if n + more > OUTPUTS and to > at:
                    break
                n, to = n + more, to + 1
            a, b = runs[at][1], runs[to - 1][2]
            yield runs[at:to], np.cumsum(wide[a:b]) - wide[a:b] + target[a:b], n
            at = to


class _Room:
    """An array for outputs, made again only where it is too small."""

    def __init__(self):
        self.z = np.empty(OUTPUTS, np.float32)

    def of(self, n: int) -> np.ndarray:
        if n > len(self.z):
            self.z = np.empty(n, np.float32)
        return self.z[:n]


def log_probs(net: Network, ids: np.ndarray, around: np.ndarray, step: int = 32768) -> np.ndarray:
    """Log probability of each id given its window."""
    out, blocks, room = np.empty(len(ids), np.float32), net.blocks(), _Room()
    for lo in range(0, len(ids), step):
        targets = _Targets(net, ids[lo : lo + step])
        h = net.hidden(net.window(around[lo : lo + step].take(targets.order, axis=0)))
        p = np.zeros(len(h), np.float32)
        for layer in range(3):
            for runs, place, n in targets.bundles(layer, split=True):
                a, b = runs[0][1], runs[-1][2]
                _, sums, logit = _softmax(h[a:b], [(blocks[layer][k], i - a, j - a) for k, i, j in runs], place, room.of(n))
                logit -= np.log(sums)
                p[a:b] += logit
        out[lo + targets.order] = p
    return out


def _row_sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; numbers are added in pairs, as complex ones, which halves the calls."""
    pairs = rows.shape[1] % 2 == 0
    return np.add.reduceat(rows.view(np.complex64) if pairs else rows, first).view(np.float32)


class Trainer:
    """Adagrad on batches of masked positions."""

    def __init__(self, net: Network, rate: float = 0.1):
        self.net, self.rate = net.filled(net.flat()), np.float32(rate)
        self.seen = [np.full(p.shape if k else len(p), 1e-3, np.float32) for k, p in enumerate(self.net.parts)]
        self.tokens = self.full = 0
        self.blocks, self.room = self.net.blocks(), _Room()
        self.seen_blocks = Network(*self.seen[:1], self.net.w, self.net.b, *self.seen[3:], self.net.side).blocks()
        self.waiting = np.zeros(0, np.int32), np.zeros((0, 2 * net.side), np.int32)

    def _step(self, weight: np.ndarray, seen: np.ndarray, grad: np.ndarray) -> None:
        """One step on some weights; the gradient is used up."""
        square = grad * grad
        seen += square
        np.sqrt(seen, out=square)
        grad /= square
        grad *= self.rate
        weight -= grad

    def _step_rows(self, ids: np.ndarray, grad: np.ndarray) -> None:
        """One step on the embeddings of ``ids``, which have one rate for each row."""
        seen = self.seen[0].take(ids) + (grad * grad) @ np.full(grad.shape[1], 1 / grad.shape[1], np.float32)
        self.seen[0][ids] = seen
        grad *= (self.rate / np.sqrt(seen))[:, None]
        self.net.e[ids] -= grad

    def _layer(self, layer: int, targets: _Targets, h: np.ndarray, dh: np.ndarray) -> None:
        """An output layer learns from positions with hidden values h; their gradient is added to dh."""
        for runs, place, n in targets.bundles(layer):
            a, b = runs[0][1], runs[-1][2]
            z, blocks = self.room.of(n), [(self.blocks[layer][k], i - a, j - a) for k, i, j in runs]
            parts, sums, _ = _softmax(h[a:b], blocks, place, z)
            z[place] -= sums
            sums *= np.float32(self.full)
            share = np.reciprocal(sums, out=sums)[:, None]
            scaled, back = h[a:b] * share, np.empty_like(h[a:b])
            for (k, _, _), (weight, i, j), part in zip(runs, blocks, parts):
                np.matmul(part, weight.T, out=back[i:j])
                self._step(weight, self.seen_blocks[layer][k], scaled[i:j].T @ part)
            back *= share
            dh[a:b] += back

    def learn(self, y: np.ndarray, x: np.ndarray, last: bool = True) -> None:
        """Learn targets y in windows x and those that wait; unless it is the ``last`` batch, classes of few targets wait on.

        A target weighs as much as in a full batch, so that a last one of rare classes does not make these seem frequent."""
        self.full = max(self.full, len(y))
        net, y, x = self.net, np.concatenate([self.waiting[0], y]), np.concatenate([self.waiting[1], x])
        cls = class_of(net.size)[y]
        wait = (np.bincount(cls, minlength=net.classes) < (0 if last else CLASS_ROWS))[cls]
        self.waiting = y[wait], x[wait]
        if wait.any():
            y, x = y[~wait], x[~wait]
        n = len(y)
        if not n:
            return
        targets = _Targets(net, y)
        x = x.take(targets.order, axis=0)
        v = net.window(x)
        h = net.hidden(v)
        dh = np.zeros_like(h)
        for layer in range(3):
            self._layer(layer, targets, h, dh)
        h, dh = h[:, :-1], dh[:, :-1]
        dz = dh * (1 - h * h)
        de = (dz @ net.w.T).reshape(-1, net.e.shape[1])
        key = (x.ravel().astype(np.int64) << 32) | np.arange(x.size)
        key.sort()
        flat = key >> 32
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        self._step(net.w, self.seen[1], v.T @ dz)
        self._step(net.b, self.seen[2], dz.sum(0))
        self._step_rows(flat[first], _row_sums(de.take(key & 0xFFFFFFFF, axis=0), first))
        self.tokens += n


def word_ids(h: np.ndarray, vocab: np.ndarray, rank: np.ndarray, size: int = VOCAB) -> np.ndarray:
    """Vocabulary ids of word hashes; ``vocab`` is sorted and ``rank`` holds its ids."""
    out = (size - OTHERS + (h & _U(OTHERS - 1)).astype(np.int32)).astype(np.int32)
    if len(vocab):
        slot = (h >> _U(64 - _SLOT_BITS)).astype(np.int32)
        first, most = _slots(vocab)
        at = first.take(slot)
        for _ in range(most):
            hit = np.flatnonzero(vocab.take(at, mode="clip") == h)
            out[hit] = rank.take(at.take(hit), mode="clip")  # past the end stands the last word again
            at += 1
    return out


#: Upper bits of a hash that choose where its search in the sorted vocabulary starts.
_SLOT_BITS = 18
_slots_of: list = [None, None]


def _slots(vocab: np.ndarray) -> tuple[np.ndarray, int]:
    """First word of each slot, and the most words in one; kept for the vocabulary in use."""
    if _slots_of[0] is not vocab:
        slot = (vocab >> _U(64 - _SLOT_BITS)).astype(np.int64)
        first = np.searchsorted(slot, np.arange(1 << _SLOT_BITS)).astype(np.int32)
        _slots_of[:] = vocab, (first, int(np.bincount(slot).max()))
    return _slots_of[1]


def _texts(batch):
    for lo, hi, data, offs in text_chunks(batch.column("text")):
        data = lower_ascii(data)
        s, e, row = word_spans(data, offs)
        yield lo, hi, hash_words(data, s, e), row


def _count_words(limit: int = 1 << 22):
    """Counts of word hashes, merged over a task until ``limit`` words wait."""

    def run(batches):
        wait, n = [], 0

        def flush():
            h, c = np.unique(np.concatenate(wait), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["word", "n"])

        for batch in batches:
            for _, _, h, _ in _texts(batch):
                wait.append(h)
                n += len(h)
            if n > limit:
                yield flush()
                wait, n = [], 0
        if n:
            yield flush()

    return run


def _train(net: Network, vocab, rank, turn: int, rounds: int, seed: int, batch_size: int, blocks: int):
    def run(batches):
        trainer, part = Trainer(net), TaskContext.get().partitionId()
        ys, xs, n = [], [], 0
        for batch in batches:
            for _, _, h, row in _texts(batch):
                ids = word_ids(h, vocab, rank, net.size)
                # The mask is hashed from word, place in the document and seed: the same however documents are read.
                first = np.flatnonzero(np.diff(row, prepend=-1))
                place = np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row)))
                dice = mix(h + place.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(seed))
                pick = np.flatnonzero((dice >> _U(32)) * _U(rounds) >> _U(32) == _U(turn))
                ys.append(ids[pick])
                xs.append(windows(ids, row, net.side, net.size)[pick])
                n += len(pick)
                if n >= batch_size:
                    y, x = np.concatenate(ys), np.concatenate(xs)
                    for lo in range(0, n - batch_size + 1, batch_size):
                        trainer.learn(y[lo : lo + batch_size], x[lo : lo + batch_size], last=False)
                    lo = n // batch_size * batch_size
                    ys, xs, n = [y[lo:]], [x[lo:]], n - lo
        if n or len(trainer.waiting[0]):
            trainer.learn(np.concatenate(ys), np.concatenate(xs))
        if trainer.tokens:
            flat = trainer.net.flat().astype(np.float64) * trainer.tokens
            pieces = np.array_split(flat, blocks)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(blocks, dtype=np.int32)),
                    pa.array(np.full(blocks, part % 64, np.int32)),
                    pa.array(np.full(blocks, trainer.tokens, np.int64)),
                    pa.array([p.astype("<f8").tobytes() for p in pieces], pa.binary()),
                ],
                names=["block", "salt", "tokens", "weights"],
            )

    return run


def _sum(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(w, "<f8") for w in group.column("weights").to_pylist())
    return pa.table(
        {
            "block": group.column("block")[:1],
            "salt": group.column("salt")[:1],
            "tokens": pa.array([sum(group.column("tokens").to_pylist())], pa.int64()),
            "weights": pa.array([total.astype("<f8").tobytes()], pa.binary()),
        }
    )


_BLOCK = "block int, salt int, tokens long, weights binary"


class Model(tuple):
    """(network, vocabulary hashes, their ids), with what tells the other words apart.

    ``rest`` (word, share) has the log share of each other word in its id, ``unseen`` that of a
    word the corpus lacks, by id.
    """

    rest: DataFrame
    unseen: list[float]


def fit_network(docs: DataFrame, *, rounds: int = 2, epochs: int = 1, batch_size: int = 4096, blocks: int = 16, seed: int = 2) -> Model:
    """The model learnt from all texts of ``docs`` (text): in each epoch every position is a target in one of the rounds."""
    counts = docs.select("text").mapInArrow(_count_words(), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "words")
    size = vocabulary_size(counts.agg(F.sum("n")).first()[0] or 0)
    top = counts.orderBy(F.desc("n"), "word").limit(size - OTHERS).toArrow()
    words = top.column("word").to_numpy().view(_U)
    order = np.argsort(words)
    vocab, rank = words[order], order.astype(np.int32)
    net = Network.fresh(seed=seed, size=size)
    for r in range(rounds * epochs):
        trained = docs.select("text").mapInArrow(_train(net, vocab, rank, r % rounds, rounds, seed, batch_size, blocks), _BLOCK)
        summed = trained.groupBy("block", "salt").applyInArrow(_sum, _BLOCK)
        rows = summed.groupBy("block").applyInArrow(_sum, _BLOCK).orderBy("block").toArrow()
        if rows.num_rows:
            flat = np.concatenate([np.frombuffer(w, "<f8") for w in rows.column("weights").to_pylist()])
            net = net.filled(flat / rows.column("tokens")[0].as_py())
    model = Model((net, vocab, rank))
    model.rest, model.unseen = _shares(counts, vocab)
    return model


def _shares(counts: DataFrame, vocab: np.ndarray) -> tuple[DataFrame, list[float]]:
    """(log share of each word outside the vocabulary in its id, that of an unseen word by id)."""
    known = counts.sparkSession.createDataFrame(pa.table({"word": pa.array(vocab.view(np.int64))}))
    rest = counts.join(F.broadcast(known), "word", "left_anti")
    id_ = F.col("word").bitwiseAND(OTHERS - 1).cast("int")
    sums = dict.fromkeys(range(OTHERS), 1) | {r.id: r.n + 1 for r in rest.groupBy(id_.alias("id")).agg(F.sum(F.col("n") + 1).alias("n")).collect()}
    unseen = [-float(np.log(sums[k])) for k in range(OTHERS)]
    return rest.select("word", (F.log(F.col("n") + 1) + F.element_at(F.lit(unseen), id_ + 1)).alias("share")), unseen


def _score(net: Network, vocab, rank):
    def run(batches):
        for batch in batches:
            for lo, hi, h, row in _texts(batch):
                ids = word_ids(h, vocab, rank, net.size)
                p = log_probs(net, ids, windows(ids, row, net.side, net.size)).astype(np.float64)
                n = np.bincount(row, minlength=hi - lo).astype(np.int64)
                total = np.bincount(row, p, hi - lo)
                other = ids >= net.size - OTHERS
                cuts = np.concatenate([[0], np.cumsum(np.bincount(row[other], minlength=hi - lo))]).astype(np.int32)
                others = pa.ListArray.from_arrays(pa.array(cuts), pa.array(h[other].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(total), others], names=["doc_id", "n_words", "pll", "others"])

    return run


def pseudo_likelihood(df: DataFrame, *, key: str = "doc_id", text: str = "text", model=None, **fit) -> DataFrame:
    """Per row: doc_id, n_words, pll (sum of log probabilities) and pll_per_word (null without words)."""
    tune(df.sparkSession)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    model = model or fit_network(docs, **fit)
    out = docs.mapInArrow(_score(*model), "doc_id long, n_words long, pll double, others array<long>")
    out = materialize(out.withColumn("row", F.monotonically_increasing_id()), "scored")
    words = out.select("row", F.explode("others").alias("word")).join(model.rest.hint("shuffle_hash"), "word", "left")
    share = F.coalesce("share", F.element_at(F.lit(model.unseen), F.col("word").bitwiseAND(OTHERS - 1).cast("int") + 1))
    shares = words.groupBy("row").agg(F.sum(share).alias("share"))
    out = out.drop("others").join(shares, "row", "left").select("doc_id", "n_words", (F.col("pll") + F.coalesce("share", F.lit(0.0))).alias("pll"))
    return out.withColumn("pll_per_word", F.when(F.col("n_words") > 0, F.col("pll") / F.col("n_words")))
