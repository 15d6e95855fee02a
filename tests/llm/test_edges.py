"""Every operator over nulls, empty and very long texts, ties, repeated rows, clashing columns and an empty table, against plain Python."""

import hashlib
import json
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import hilbert, jump, lines, mixing, mlm, ngram_join, packing, pu, substring, wavelet
from quarryline.llm.tokens import PieceEncoder, public_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, n int, found string, host string, component_id long, rank int, x string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def make_rows():
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdeéßXYZ,.|") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = prose(120), prose(20)
    near = base.split()
    near[60] = "changed"
    texts = {0: base, 1: " ".join(near), 2: base, 3: None, 4: "", 5: " \n\t ", 6: "one", 7: "One two", 8: "one TWO", 9: prose(30) + " " + passage + "\n" + prose(30)}
    texts |= {10: prose(5) + "\n" + passage, 11: "\n".join(["same line here"] * 30), 12: "a b c " * 40, 13: " ".join(vocab[i % 397] for i in range(60_000)), 14: "日本語 テスト 🙂 " + prose(40)}
    texts |= {i: prose(rng.randint(1, 80)) for i in range(20, 60)}
    texts |= {i: "boilerplate line\n" + prose(60) for i in range(60, 70)}
    rows = list(texts.items()) + [(0, base), (0, base), (3, None), (None, passage + " tail"), (None, None), (40, "other text under a used id " + passage)]
    return [(i, t, "en", None if i and i % 7 == 0 else f"s{(i or 0) % 2}", len(t or ""), 1, 2, "f", "h", 9, 1, "x") for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def encode():
    def of(name, end):
        e = PieceEncoder(public_path(name))
        return lambda t: e._ids([t or ""])[0] + struct.pack("<I", end)

    return of


def bag(it):
    return Counter(map(tuple, it))


def test_op1_files_return_every_token(spark, docs, rows, encode, empty):
    enc = encode("byte_bpe_50k.json", 2)
    folder = wavelet.new_folder(spark)
    got = wavelet.read_wavelet_shards(folder, wavelet.write_wavelet_shards(docs, folder, shard_tokens=20_000)).collect()
    want = bag((i, len(enc(t)) // 4, zlib.crc32(enc(t))) for i, t, *_ in rows)
    assert bag((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert len({r.shard for r in got}) > 1
    at = 0
    ids = []
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        ids.append(r.doc_id)
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    folder = wavelet.new_folder(spark)
    assert wavelet.read_wavelet_shards(folder, wavelet.write_wavelet_shards(empty, folder)).count() == 0


def test_wavelet_access_rank_select():
    rng = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 1), (3000, 2), (300_000, 70_000)):
        ids = rng.integers(0, top, n)
        f = wavelet.WaveletFile(wavelet.pack_wavelet(ids, np.arange(2), np.zeros(2), np.array([n, 0])))
        assert (f.decode() == ids).all()
        for i in rng.integers(0, n, 12 if n else 0):
            t = int(ids[i])
            where = np.flatnonzero(ids == t)
            assert f.access(int(i)) == t and f.count(t) == len(where) and f.count(t, 0, int(i)) == (where < i).sum()
            k = int(rng.integers(0, len(where)))
            assert f.select(t, k) == where[k]
        assert f.count(top + 1) == 0
        with pytest.raises(IndexError):
            f.access(n)


def test_op2_equals_a_loop_and_prefers_the_corpus(spark, docs, rows, empty):
    slim = docs.select("doc_id", "text")
    net, vocab, rank = model = mlm.fit_network(slim, rounds=2, epochs=2, batch_size=256)
    got = mlm.pseudo_likelihood(docs, model=model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id in (8, 10)}
    for i in by:
        from quarryline.llm.common import hash_words, lower_ascii

        text = next(t for j, t, *_ in rows if j == i)
        ids = []
        for w in text.encode().split():
            data = lower_ascii(np.frombuffer(w, np.uint8))
            ids.append(int(mlm.word_ids(hash_words(data, np.array([0]), np.array([len(data)])), vocab, rank)[0]))
        total = 0.0
        for k, y in enumerate(ids):
            window = [ids[j] if 0 <= j < len(ids) else mlm.VOCAB for j in (k - 2, k - 1, k + 1, k + 2)]
            h = np.tanh(np.concatenate([net.e[v] for v in window]) @ net.w + net.b)
            a, b = h @ net.c + net.cb, h @ net.o[y // 64] + net.ob[y // 64]
            total += a[y // 64] - np.log(np.exp(a).sum()) + b[y % 64] - np.log(np.exp(b).sum())
        assert by[i].n_words == len(ids) and by[i].pll == pytest.approx(total, rel=1e-3)
    none = [r for r in got if r.doc_id in (3, 4, 5)]
    assert all(r.n_words == 0 and r.pll == 0.0 and r.pll_per_word is None for r in none)
    words_ = " ".join(t for _, t, *_ in rows if t).split()[:3000]
    known = spark.createDataFrame([(1, " ".join(words_)), (2, " ".join(f"zz{i}" for i in range(3000)))], "doc_id long, text string")
    score = {r.doc_id: r.pll_per_word for r in mlm.pseudo_likelihood(known, model=model).collect()}
    assert score[1] > score[2]
    assert mlm.pseudo_likelihood(empty).count() == 0


def test_op2_rare_words_have_their_own_probability(spark):
    from quarryline.llm.common import hash_words

    rng = random.Random(3)
    count = {f"w{i}": 5 if i < 4032 else 1 + i % 3 for i in range(6000)}
    tokens = [w for w, n in count.items() for _ in range(n)]
    rng.shuffle(tokens)
    corpus = spark.createDataFrame([(i, " ".join(tokens[i : i + 100])) for i in range(0, len(tokens), 100)], "doc_id long, text string")
    model = mlm.fit_network(corpus, batch_size=256)
    rare = [f"w{i}" for i in range(4032, 6000, 5)] + [f"zz{i}" for i in range(40)]
    table = spark.createDataFrame([(i, f"w1 w2 {w} w3 w4") for i, w in enumerate(rare)], "doc_id long, text string")
    score = {rare[r.doc_id]: r.pll for r in mlm.pseudo_likelihood(table, model=model).collect()}
    raw = {w: np.frombuffer(w.encode(), np.uint8) for w in rare}
    bucket = defaultdict(list)
    for w, b in raw.items():
        bucket[int(hash_words(b, np.array([0]), np.array([len(b)]))[0] % mlm.OTHERS)].append(w)
    for held in bucket.values():
        for w in held[1:]:
            assert score[w] - score[held[0]] == pytest.approx(np.log((count.get(w, 0) + 1) / (count.get(held[0], 0) + 1)), abs=1e-5)


def test_op2_vocabulary_grows_with_the_corpus():
    sizes = [mlm.vocabulary_size(n) for n in (0, 10**6, 10**8, 10**10)]
    assert sizes == sorted(sizes) and sizes[0] == mlm.VOCAB and sizes[3] > 9 * sizes[2] > 40 * sizes[0]
    net = mlm.Network.fresh(size=sizes[2])
    p = mlm.log_probs(net, np.arange(sizes[2]), np.zeros((sizes[2], 4), np.int32))
    assert np.exp(p.astype(float)).sum() == pytest.approx(1, abs=1e-3)
    trainer = mlm.Trainer(net)
    y, x = np.array([sizes[2] - 1] * 64), np.full((64, 4), sizes[2])
    for _ in range(20):
        trainer.learn(y, x)
    assert mlm.log_probs(trainer.net, y, x)[0] > -1


def test_op2_outputs_of_a_position_grow_slowly():
    """Under Zipf's law a position costs the classes and its own class's words: both layers together, well under two equal steps."""
    for tokens in (10**8, 10**10):
        size = mlm.vocabulary_size(tokens)
        net = mlm.Network.fresh(size=size)
        words = [len(b) for b in net.ob]
        assert sum(words) == size and net.cc.shape[1] == len(words)
        share = 1 / np.arange(1, size + 1)
        share[-mlm.OTHERS :] = share[: -mlm.OTHERS].sum() / 3 / mlm.OTHERS  # a quarter of all words are others
        share /= share.sum()
        assert len(words) + (share * np.repeat(words, words)).sum() < 1.4 * size**0.5


def test_op2_outputs_do_not_grow_with_the_square_root():
    """Three steps (group, class, word): the outputs worked on for a position, counted by their exponentials, and the cost of a batch."""
    import unittest.mock as mock

    rng, outputs, exp = np.random.default_rng(4), [], np.exp
    for tokens in (10**8, 10**10):
        size = mlm.vocabulary_size(tokens)
        net, share = mlm.Network.fresh(size=size), 1 / np.arange(1, size + 1)
        share[-mlm.OTHERS :] = share[: -mlm.OTHERS].sum() / 3 / mlm.OTHERS
        y = rng.choice(size, 20000, p=share / share.sum())
        done = []
        with mock.patch.object(np, "exp", lambda z, **to: (done.append(z.size), exp(z, **to))[1]):
            mlm.log_probs(net, y, rng.integers(0, size, (20000, 4)))
        outputs.append(sum(done) / len(y))
        assert outputs[-1] < 0.8 * size**0.5
    assert outputs[1] < 2.5 * outputs[0]


def test_op2_targets_that_wait_are_learned_once():
    """Rare classes' targets wait for more of their kind; none is lost, none is learned twice, whatever the batch."""
    import unittest.mock as mock

    import pyarrow as pa

    texts = [" ".join(f"w{i * j % 97}" for j in range(40)) for i in range(40)]
    got = []

    class Count(mlm._Targets):
        def __init__(self, net, y):
            super().__init__(net, y)
            got[-1].append(np.sort(y))

    with mock.patch.object(mlm, "_Targets", Count), mock.patch.object(mlm, "TaskContext") as task:
        task.get().partitionId.return_value = 0
        for size in (10**6, 7, 100, 1600):
            got.append([])
            out = list(mlm._train(mlm.Network.fresh(), np.zeros(0, np.uint64), np.zeros(0, np.int32), 0, 1, 1, size, 1)([pa.RecordBatch.from_pydict({"text": texts})]))
            assert out[0].column("tokens").to_pylist() == [1600]
    assert all(np.array_equal(np.sort(np.concatenate(g)), np.concatenate(got[0])) for g in got) and len(got[2]) > 5


def test_op2_large_outputs_are_exact():
    """Logits far from zero: probabilities still sum to one, and training stays finite."""
    net = mlm.Network.fresh()
    net.block(1, 0)[-1, 3] = 300
    net.block(2, 3)[-1] = -500
    ids = np.arange(mlm.VOCAB)
    p = mlm.log_probs(net, ids, np.zeros((len(ids), 4), np.int32)).astype(float)
    assert np.exp(p).sum() == pytest.approx(1, abs=1e-3) and p[192:256].max() > -5
    trainer = mlm.Trainer(net)
    trainer.learn(ids, np.zeros((len(ids), 4), np.int32))
    assert np.isfinite(trainer.net.flat()).all()


def test_op3_equals_brute_force(docs, rows, empty):
    big = 1 << 62
    seen = {}
    for i, t, *_ in rows:
        w = words(t)
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            seen[k] = min(seen.get(k, big), big if i is None else i)
    want = []
    for i, t, *_ in rows:
        w = words(t)
        gone = set()
        for j in range(len(w) - 12):
            if seen[tuple(w[j : j + 13])] < (big if i is None else i):
                gone |= set(range(j, j + 13))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = bag((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_digest(docs).collect())
    assert got == bag(want) and sum(w[2] for w in want) > 100
    left = {r.doc_id: r for r in substring.remove_repeats(docs.where("doc_id is not null")).collect()}
    assert 2 not in left and left[9].text == rows[9][1] and words(left[10].text) == words(rows[10][1])[:5]
    assert left[10].n_chars == len(left[10].text) and left[10].host == "h"
    assert substring.substring_digest(empty).count() == 0


def jump_model(key, n):
    b, j = 0, 0
    while j < n:
        b = j
        draw = (int(hashlib.md5(f"{'null' if key is None else key}:{b}".encode()).hexdigest()[:13], 16) + 1) / 2**52
        j = int((b + 1) / draw)
    return b


def test_op4_shards(docs, rows, empty):
    got = jump.shard_documents(docs, 8).collect()
    assert bag((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == bag((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), jump_model(i, 8), jump_model(i, 9)) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert jump.shard_documents(empty, 8).count() == 0


def test_jump_moves_only_the_needed_share(spark):
    rows = spark.range(20_000).select(jump.jump_shard(F.col("id"), 8).alias("a"), jump.jump_shard(F.col("id"), 9).alias("b"))
    counts = Counter(r.a for r in rows.collect())
    moved = rows.where("a <> b").collect()
    assert all(r.b == 8 for r in moved) and abs(len(moved) - 20_000 / 9) < 200
    assert max(counts.values()) - min(counts.values()) < 300


def test_op5_base_figures_and_verdicts(docs, rows, empty):
    measured = lines.measure_texts(docs)
    got = lines.line_verdicts(measured, max_docs=3).collect()

    def base(t):
        t = t or ""
        w = words(t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        with_words = [x for x in t.split("\n") if words(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(with_words) - len(set(with_words)), len(cover)

    norm = lambda x: " ".join(words(lower(x)))
    having = defaultdict(set)
    first = {}
    for i, t, _, s, *_ in rows:
        for x in {norm(x) for x in (t or "").split("\n")} - {""}:
            having[s, x].add(t)
            first[s, x] = min(first.get((s, x), (1, 0)), (i is not None, i or 0))
    want = []
    for i, t, _, s, *_ in rows:
        b = base(t)
        gone = sum(len(words(x)) for x in (t or "").split("\n") if norm(x) and len(having[s, norm(x)]) > 3 and first[s, norm(x)] != (i is not None, i or 0))
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        want.append((i, *b, failed, not failed and b[0] - gone >= 0.3 * b[0]))
    assert bag((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == bag(want)
    kept = lines.apply_line_rules(docs, max_docs=3)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert bag((r.doc_id,) for r in kept) == bag((w[0],) for w in want if w[7])
    assert sum("boilerplate" in r.text for r in kept) < 10 and all(r.n_chars == len(r.text) for r in kept)
    assert lines.line_verdicts(lines.measure_texts(empty)).count() == 0 and lines.apply_line_rules(empty).count() == 0


def test_op6_packs_every_token_once(docs, rows, encode, empty):
    enc = encode("word_bpe_49k.json", 1)
    got = packing.pack_documents(docs).collect()
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and 0 < r.length <= 2048
        seqs[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert sum(r.length for r in got) == sum(len(enc(t)) // 4 for _, t, *_ in rows)
    long = sorted(pieces[13], key=lambda r: r.start)
    assert b"".join(r.ids for r in long) == enc(rows[13][1])
    assert sum(r.length for r in got) / (2048 * len(seqs)) > 0.95
    assert packing.pack_documents(empty).count() == 0


def test_first_fit_is_first_fit():
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(1, 60))]
        bins, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            b = next((b for b, used in enumerate(bins) if used + sizes[i] <= 50), len(bins))
            if b == len(bins):
                bins.append(0)
            want[i] = b, bins[b]
            bins[b] += sizes[i]
        assert packing.first_fit_decreasing(sizes, 50) == [want[i] for i in range(len(sizes))]


def shingles(t):
    w = words(lower(t))
    return frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def classes(items, percent=90):
    """Smallest id reachable by links, by comparing all pairs."""
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(items):
        top(i)
        for j, t in items[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return [top(i) for i, _ in items]


def test_op7_equals_all_pairs(docs, rows, empty):
    big = 1 << 62
    items = [(big if i is None else i, shingles(t)) for i, t, *_ in rows]
    want = bag((None if i == big else i, len(s), None if c == big else c) for (i, s), c in zip(items, classes(items), strict=True))
    got = bag((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs).collect())
    assert got == want
    assert ngram_join.similar_documents(empty).count() == 0
    assert {r.doc_id for r in ngram_join.one_of_each(docs).collect()} >= {0, 3, 4, 6, 9, None}


@pytest.mark.parametrize("often", [2, 32])
def test_op7_large_near_group(spark, often):
    """A group of near copies with 0 to 6 changed words each: few pairs link, and each link counts."""
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    items = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(150)] = f"x{rng.randint(0, 40)}"
        items.append((i, " ".join(w)))
    for i in range(160, 240):
        items.append((i, " ".join([f"u{i}_{k}" for k in range(rng.randint(3, 60))] + base[:20])))
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(spark.createDataFrame(items, "doc_id long, text string"), often=often).collect()}
    want = classes([(i, shingles(t)) for i, t in items])
    assert [got[i] for i, _ in items] == want and 10 < len(set(want)) < 230


@pytest.mark.parametrize("often", [2, 32])
def test_five_word_shingles_at_80_percent_equal_all_pairs(spark, docs, rows, often):
    def five(t):
        w = words(lower(t))
        return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    rng = random.Random(9)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    items = [(1000 + i, t) for i, (_, t, *_) in enumerate(rows) if len(words(t)) < 1000]
    for i in range(160):
        w = base[: rng.choice([12, 60, 150])]
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 40)}"
        items.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(spark.createDataFrame(items, "doc_id long, text string"), words=5, percent=80, often=often).collect()}
    want = classes([(i, five(t)) for i, t in items], 80)
    assert [got[i] for i, _ in items] == want and 10 < len(set(want)) < len(items) - 50


def test_link_forest_of_two_sides():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 10**9, 100).astype(np.uint64)
    sets = []
    for _ in range(60):
        s = base.copy()
        s[rng.choice(100, rng.integers(0, 9), False)] = rng.integers(0, 10**9, 1)
        sets.append(np.unique(s))
    label = ngram_join.link_forest(sets[:25], sets[25:], 90, wide=16)
    items = [(i, frozenset(s.tolist())) for i, s in enumerate(sets)]
    up = list(range(60))
    changed = True
    while changed:
        changed = False
        for i in range(25):
            for j in range(25, 60):
                a, b = items[i][1], items[j][1]
                if 100 * len(a & b) >= 90 * len(a | b) and up[i] != up[j]:
                    up[i] = up[j] = min(up[i], up[j])
                    changed = True
    assert label.tolist() == up


def test_op8_learns_shapes(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, int(i >= 20), 5) for i, *_ in rows if i is not None], "doc_id long, quality int, n int")
    got = pu.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = labels.where("quality > 5")
    assert {r.score for r in pu.quality_scores(docs, none).collect()} == {0.5}
    assert pu.quality_scores(empty, labels).count() == 0


def test_op8_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    scores = pu.quality_scores(spark.read.parquet(f"{d}/documents.parquet"), labels, learn=pu.fold_of(F.col("doc_id")) != 2)
    held = scores.join(labels, "doc_id").where(pu.fold_of(F.col("doc_id")) == 2).collect()
    good, bad = [r for r in held if r.quality == 1], [r for r in held if r.quality == 0]
    assert sum(r.score >= 0.7 for r in good) / len(good) > 0.95 and sum(r.score < 0.7 for r in bad) / len(bad) > 0.8


def test_op9_counts_and_order(docs, rows, empty):
    got = mixing.poisson_mix(docs, seed=3)
    assert set(docs.columns) < set(got.columns)
    rates = {r.source: r.rate for r in mixing.source_rates(docs).collect()}
    size = Counter()
    for _, t, _, s, *_ in rows:
        size[s] += len((t or "").encode()) + 1
    total = sum(v**0.5 for v in size.values())
    assert all(rates[s] == pytest.approx(sum(size.values()) * (v**0.5 / total) / v) for s, v in size.items())

    def quantile(u, rate):
        n, term = 0, np.exp(-rate)
        cdf = term
        while u >= cdf and n < 80:
            n += 1
            term *= rate / n
            cdf += term
        return n

    want = Counter()
    for i, t, _, s, *_ in rows:
        u = int(hashlib.md5(f"3:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        want[i, t, s] += quantile(u, rates[s])
    assert Counter((r.doc_id, r.text, r.source) for r in got.collect()) == +want
    assert mixing.poisson_mix(empty).count() == 0
    assert mixing.poisson_mix(docs, weights={}).count() == 0


def test_poisson_means(spark):
    for mean in (0.2, 1.0, 5.5, 40.0):
        u = mixing.hashed_uniform(F.lit("t"), F.col("id"))
        m, v = spark.range(20_000).select(mixing.poisson_quantile(u, F.lit(mean)).alias("n")).agg(F.avg("n"), F.var_samp("n")).first()
        assert m == pytest.approx(mean, rel=0.05) and v == pytest.approx(mean, rel=0.06)


def test_op10_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16))
    x[1000:2000] = x[1000]  # a third of all rows
    rows = [(i, v.tolist(), 0, 1) for i, v in enumerate(x)]
    rows += [(5000, None, 0, 1), (5100, [0.0] * 16, 0, 1), (5200, [1.0], 0, 1), (5300, [float("nan")] * 16, 0, 1), (5400, [None] + [1.0] * 15, 0, 1), (None, x[0].tolist(), 0, 1), (7, x[7].tolist(), 0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, block int")
    got = defaultdict(dict)
    for r in hilbert.hilbert_search(df, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id][r.rank] = (r.score, r.vec_id)
    assert set(got) == set(range(0, 3000, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10]
        assert sorted(found) == list(range(1, 11)) and all(s == pytest.approx(d[v], abs=1e-12) for s, v in found.values())
        hit += len({v for _, v in found.values()} & set(best.tolist()))
        if 1000 <= q < 2000:
            assert [found[k][1] for k in range(1, 11)] == best.tolist()
    assert hit / (10 * len(got)) >= 0.9
    assert hilbert.hilbert_search(df.where("vec_id < 0"), F.col("vec_id") % 100 == 0).count() == 0
    few = hilbert.hilbert_search(df.where("vec_id < 3"), F.col("vec_id") % 100 == 0).collect()
    assert [(r.query_id, r.rank) for r in sorted(few, key=lambda r: r.rank)] == [(0, 1), (0, 2)]


def test_hilbert_keys_are_a_walk():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    k = hilbert.hilbert_key(g, 3)
    assert sorted(k.tolist()) == list(range(512))
    assert (np.abs(np.diff(g[np.argsort(k)], axis=0)).sum(1) == 1).all()


def test_op10_recall_on_the_test_table(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in t.collect()}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    got = defaultdict(set)
    for r in hilbert.hilbert_search(t, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((m - x[q]) ** 2).sum(1))
        d[ids == q] = np.inf
        hit += len(found & set(ids[np.argsort(d)[:10]].tolist()))
    assert hit / (10 * len(got)) >= 0.9


def test_encoders_equal_the_library():
    odd = ["  a b", "a  b", "a \n b", "it's  'S don't we'LL", " x y z", "", "\n", " ", "á ́b é", "ΣΑΣ ΟΔΟΣ.", "<|endoftext|> a<|endoftext|>b", "a\tb\x1cc d\x85e", "12 3", "x ", "İß÷×", " x y"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = PieceEncoder(public_path(name))
        assert e.encode(odd) == e._ids(odd), json.dumps(name)


def test_op2_hears_both_sides_and_the_order(spark):
    """A unigram model would score the shuffled texts like the others; one side alone could not tell the middle words apart."""
    rng = random.Random(5)
    middle = {(a, b): f"m{a}{b}" for a in range(6) for b in range(6)}
    pick = lambda: (lambda a, b: f"l{a} {middle[a, b]} r{b}")(rng.randrange(6), rng.randrange(6))
    corpus = [(i, " ".join(pick() for _ in range(30))) for i in range(400)]
    model = mlm.fit_network(spark.createDataFrame(corpus, "doc_id long, text string"), rounds=2, epochs=6, batch_size=256)
    held = [" ".join(pick() for _ in range(30)) for _ in range(20)]
    mixed = [" ".join(rng.sample(t.split(), 90)) for t in held]
    table = spark.createDataFrame(list(enumerate(held + mixed)), "doc_id long, text string")
    score = {r.doc_id: r.pll for r in mlm.pseudo_likelihood(table, model=model).collect()}
    assert all(score[i] > score[i + 20] + 50 for i in range(20))
    net, vocab, rank = model

    def middle_of(left: str, right: str) -> np.ndarray:
        from quarryline.llm.common import hash_words

        data = [np.frombuffer(w.encode(), np.uint8) for w in (left, right, *middle.values())]
        ids = np.concatenate([mlm.word_ids(hash_words(d, np.array([0]), np.array([len(d)])), vocab, rank) for d in data])
        window = np.array([[net.size, ids[0], ids[1], net.size]] * 36)
        return mlm.log_probs(net, ids[2:], window).reshape(6, 6)

    by_left, by_right = middle_of("l1", "r2") - middle_of("l4", "r2"), middle_of("l1", "r2") - middle_of("l1", "r5")
    assert by_left[1].mean() > by_left[4].mean() + 0.5 and by_right[:, 2].mean() > by_right[:, 5].mean() + 0.5


def test_op2_masks_do_not_depend_on_chunks():
    """The same positions are trained on however documents are batched."""
    texts = [f"w{i} w{i % 7} x{i % 3} y" for i in range(200)]
    tokens = []

    class Count(mlm.Trainer):
        def learn(self, y, x):
            tokens.append(sorted(map(tuple, np.column_stack([y, x]).tolist())))

    import unittest.mock as mock

    import pyarrow as pa

    with mock.patch.object(mlm, "Trainer", Count), mock.patch.object(mlm, "TaskContext"):
        for size in (200, 7):
            net = mlm.Network.fresh()
            list(mlm._train(net, np.zeros(0, np.uint64), np.zeros(0, np.int32), 0, 3, 1, 10**6, 1)(pa.RecordBatch.from_pydict({"text": texts[i : i + size]}) for i in range(0, 200, size)))
    assert tokens[0] == tokens[1] and len(tokens[0]) > 100


def test_op8_risk_gradient_by_finite_differences():
    rng = np.random.default_rng(1)
    good, web = rng.normal(1, 1, (40, 5)), rng.normal(0, 1, (60, 5))
    net = pu.PuNet(good, hidden=3)
    zp, zu, prior = net.scaled(good), net.scaled(web), 0.3

    def risk() -> tuple[float, float]:
        gp, gu = net.forward(zp)[1], net.forward(zu)[1]
        return prior * np.logaddexp(0, -gp).mean(), np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()

    (hp, gp), (hu, gu) = net.forward(zp), net.forward(zu)
    sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
    as_good = net.gradient(zp, hp, prior * (sp - 1) / len(zp))
    as_bad = [a + b for a, b in zip(net.gradient(zu, hu, su / len(zu)), net.gradient(zp, hp, -prior * sp / len(zp)), strict=True)]
    for k, p in enumerate(net.p):
        for i in np.ndindex(p.shape):
            p[i] += 1e-6
            up = risk()
            p[i] -= 2e-6
            down = risk()
            p[i] += 1e-6
            assert as_good[k][i] == pytest.approx((up[0] - down[0]) / 2e-6, abs=1e-6)
            assert as_bad[k][i] == pytest.approx((up[1] - down[1]) / 2e-6, abs=1e-6)


def test_op8_estimates_the_prior_without_negatives():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.6, 0.85):
        good = rng.normal(2, 1, 4000)
        web = np.where(rng.random(8000) < share, rng.normal(2, 1, 8000), rng.normal(-2, 1, 8000))
        assert pu.estimate_prior(good, web) == pytest.approx(share, abs=0.06)
    assert 0.05 <= pu.estimate_prior(np.ones(3), np.zeros(4)) <= 0.95


def test_op7_tiles_of_a_large_group(spark, monkeypatch):
    """One group over many tiles: chains of near copies that the hub does not link, and a class that fills tiles of its own."""
    monkeypatch.setattr(ngram_join, "TILE", 4000)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(40):  # a chain: each differs from the last by one word, the ends by many
        base = [*base]
        base[3 * i] = f"c{i}"
        texts.append(" ".join(base))
    texts += [" ".join([*texts[0].split(), f"t{i}"]) for i in range(25)]
    rng.shuffle(texts)

    def shingles(t: str) -> set:
        w = t.split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 90 * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(table, often=2).collect()}
    assert got == dict(enumerate(label))


def test_op9_partitions_are_even_and_names_may_clash(spark):
    table = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("some text").alias("text"), F.lit("mine").alias("mix_key"), F.lit(1).alias("__source"))
    mixed = mixing.poisson_mix(table)
    assert mixed.columns == ["doc_id", "source", "text", "__source", "mix_rate", "mix_count", "mix_copy", "mix_key"]
    sizes = [r["count"] for r in mixed.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(sizes) == n and max(sizes) <= 1.5 * sum(sizes) / n
    assert set(mixing.poisson_mix(table, prefix="own_").columns) >= {"mix_key", "own_key"}


def test_op6_many_groups_and_one_past_the_largest_id(spark):
    texts = [(i, "word " * (i % 50)) for i in range(200)] + [(None, "none"), (2**63 - 1, "last")]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    rows = packing.pack_documents(table, group_docs=10, capacity=64).collect()
    fill = defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    assert len({s >> 32 for s in fill}) > 10
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert {r.doc_id for r in rows} == {t[0] for t in texts}
    assert {r.doc_id for r in substring.substring_digest(table).collect()} == {t[0] for t in texts}
    assert {(r.doc_id, r.component_id) for r in ngram_join.similar_documents(table).collect()} >= {(None, None), (2**63 - 1, 2**63 - 1)}


def test_op5_acts_in_small_hosts(spark):
    rows = [(i, f"a line of host {'ab'[i % 2]}\n" + " ".join(f"w{i}x{k}" for k in range(60)), "ab"[i % 2]) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.n_removed_words for r in lines.line_verdicts(lines.measure_texts(table)).collect()}
    assert got == {i: 0 if i < 2 else 5 for i in range(40)}  # the host's first document keeps its line


def test_op10_blocks_hold_a_crowded_key(spark):
    """Vectors crowded into one cell of every curve are still cut into blocks; norms count."""
    rng = np.random.default_rng(3)
    crowd = np.ones((1500, 8)) + rng.normal(0, 1e-5, (1500, 8))
    spread = rng.normal(0, 1, (1500, 8)) * rng.choice([1.0, 10.0], (1500, 1))
    x = np.concatenate([crowd, spread])
    keys = hilbert.ordered_keys(crowd, rng.integers(0, 2**62, 1500), hilbert.curve_frames(8, 1, 8, 1)[0], 7, 1.0)
    assert len(np.unique(keys)) > 100
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in hilbert.hilbert_search(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 3000, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.argsort(d, kind="stable")[:10]
        assert len(got[q]) == 10 and all(s == pytest.approx(d[v], rel=1e-9) for v, s in got[q])
        hits += len(set(best.tolist()) & {v for v, _ in got[q]})
    assert hits / 600 >= 0.9


def test_components_of_chains_stars_and_loops(spark):
    from quarryline.llm.components import components

    def found(edges):
        rows = components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()
        assert len(rows) == len({r.node for r in rows})
        return {r.node: r.component for r in rows}

    chain = [(k, k + 1) for k in range(10, 30)]
    star = [(100, k) for k in range(101, 110)] + [(105, 100), (101, 100)]
    assert found(chain + star + [(7, 7), (201, 200)]) == dict.fromkeys(range(10, 31), 10) | dict.fromkeys(range(100, 110), 100) | dict.fromkeys((200, 201), 200)
    assert found([(3, 1), (3, 2), (2, 4)]) == dict.fromkeys((1, 2, 3, 4), 1)
    assert found([]) == {}
