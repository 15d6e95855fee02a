"""Operators 11 to 13 against plain Python: nulls, ties, repeated rows, long and hot groups, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import collocations, langid, pu, trie

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_phrases(rows, least, share, longest=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(11)
    vocab = ["the", "New", "york", "ßtadt", "a", "b", "日本", "x\x1cy", "(end)", "é", "non split", "I'm"]
    rows = []
    for i in range(160):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        text = "".join(w + rng.choice([" ", "  ", "\t", ", ", ".", "\n", "; ", " ", " "]) for w in words)
        rows.append((text + " in new York city of light" * (i % 3), ["en", "de", None, "und"][i % 4]))
    rows += [(None, "en"), ("", None), (" .,; ", "de"), ("only", "fr")]
    rows += [("a a a a a a a b. " * 30, "en")] * 6 + [("the new york " * 4000, "de")]
    return rows


@pytest.mark.parametrize(("share", "top"), [(100, 2000), (60, 5)])
def test_phrases_equal_brute_force(spark, talk, share, top):
    df = spark.createDataFrame([(t, la, 1, "x", 2, 3) for t, la in talk], "text string, lang string, n long, phrase string, shard int, grp long").repartition(5)
    got = collocations.mine_phrases(df, least=12, share=share, top=top).collect()
    want = brute_phrases(talk, 12, share, top=top)
    assert sorted(tuple(r) for r in got) == want and len(want) > 10


def test_phrases_over_a_grid_of_small_shards(spark, talk, monkeypatch):
    monkeypatch.setattr(collocations, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(collocations, "SHARD_BYTES", 300)
    monkeypatch.setattr(collocations, "BLOCK_PATTERNS", 5)
    monkeypatch.setattr(collocations, "GATHERED", 100)
    df = spark.createDataFrame(talk, "text string, lang string").repartition(3)
    assert sorted(tuple(r) for r in collocations.mine_phrases(df, least=12).collect()) == brute_phrases(talk, 12, 100)


def test_a_poor_sketch_changes_no_result(spark, talk, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_CELLS", 8)
    monkeypatch.setattr(collocations, "MOST_CELLS", 8)
    df = spark.createDataFrame(talk, "text string, lang string")
    assert sorted(tuple(r) for r in collocations.mine_phrases(df, least=12).collect()) == brute_phrases(talk, 12, 100)


def test_scores_are_exact_beyond_64_bits(spark):
    a, n = 3_000_000_000_007, 9_000_000_000_000_011
    rows = [("en", "", n), ("en", "x y", a), ("en", "x", a + 5), ("en", "y", a + 9)]
    got = collocations.score_phrases(spark.createDataFrame(rows, "lang string, phrase string, n long")).collect()
    assert [r.score for r in got] == [1000 * a * n // ((a + 5) * (a + 9))]


def test_phrases_of_an_empty_table(spark):
    assert collocations.mine_phrases(spark.createDataFrame([], "text string, lang string")).collect() == []


# --- languages

TALE = {
    "en": "the quick brown fox jumps over the lazy dog while the children watch from their window and laugh with their mother",
    "de": "der schnelle braune fuchs springt über den faulen hund während die kinder am fenster stehen und mit ihrer mutter lachen",
    "fr": "le renard brun et rapide saute par dessus le chien paresseux pendant que les enfants regardent à la fenêtre avec leur mère",
}


def test_interpolated_kneser_ney_equals_a_plain_model():
    texts = {k: [v, v[:40], "ab " + v[20:60]] for k, v in TALE.items()}
    grams, plain = [], {}
    for lang in sorted(texts):
        c = Counter()
        for t in texts[lang]:
            s = " " * (langid.ORDER - 1) + re.sub(r"[^\w]+", " ", t.lower()).strip() + " "
            c.update(s[i - langid.ORDER : i] for i in range(langid.ORDER, len(s) + 1))
        plain[lang] = {langid.ORDER: c}
        for k in range(langid.ORDER - 1, 0, -1):
            plain[lang][k] = Counter(g[1:] for g in plain[lang][k + 1])
        grams.append((np.array([[ord(x) for x in g] for g in c], np.uint32), np.array(list(c.values()))))
    model = langid.KneserNey(grams)
    alphabet = {g for lang in plain for g in plain[lang][1]}

    def probability(lang, gram):
        if not gram:
            return 1 / (len(alphabet) + 1)
        counts = plain[lang][len(gram)]
        ones, twos = (sum(v == k for v in counts.values()) for k in (1, 2))
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        mine = {g: v for g, v in counts.items() if g[:-1] == gram[:-1]}
        lower = probability(lang, gram[1:])
        return (max(counts[gram] - d, 0) / sum(mine.values()) if gram in mine else 0) + d * len(mine) / sum(mine.values()) * lower if mine else lower

    said = " " * (langid.ORDER - 1) + "the children zq lachen über ж "
    codes = np.array([ord(x) for x in said], np.uint32)
    at = np.arange(langid.ORDER - 1, len(said))
    got = model.log_probability(codes, at)
    for j, lang in enumerate(sorted(texts)):
        want = [math.log(probability(lang, said[i - langid.ORDER + 1 : i + 1])) for i in at]
        assert np.allclose(got[:, j], want, atol=1e-4)
        # The characters of the alphabet and one unseen character share all the probability.
        every = [model.log_probability(np.array([*map(ord, "the"), ord(x)], np.uint32), np.array([3]))[0, j] for x in [*alphabet, "一"]]
        assert abs(sum(map(math.exp, every)) - 1) < 1e-4


def test_characters_are_words_of_letters_with_single_spaces():
    codes, offs = langid.char_codes(["A1b--ß", "", "...", "x"])
    said = ["".join(map(chr, codes[a:b])) for a, b in zip(offs[:-1], offs[1:], strict=True)]
    assert said == ["   a b ß ", "   ", "   ", "   x "]


@pytest.fixture(scope="module")
def speech():
    rng = random.Random(3)
    rows = []
    for i in range(600):
        lang = rng.choice(list(TALE))
        words = TALE[lang].split()
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 60))).capitalize() + ".", lang))
    return rows + [(700, None, "en"), (701, "", "de"), (702, "123 -- !", "fr"), (703, TALE["de"], None), (704, "日本語", "en"), (None, TALE["fr"], "fr"), (705, (TALE["en"] + " ") * 3000, "en")]


def test_languages_are_found_on_rows_that_were_not_learned(spark, speech):
    df = spark.createDataFrame([(*r, 5, "x") for r in speech], "doc_id long, text string, lang string, n int, lang_pred string").repartition(4)
    learn = pu.fold_of(F.col("doc_id")) != 2
    got = {r.doc_id: r for r in langid.identify_languages(df, learn=learn).collect()}
    assert len(got) == len(speech)
    held = [(i, lang) for i, t, lang in speech if i is not None and i < 600 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == lang for i, lang in held) / len(held) > 0.98
    assert [got[i].lang_pred for i in (700, 701, 702)] == ["und"] * 3 and got[700].score == 0 and got[700].cross_entropy is None
    assert got[703].lang_pred == "de" and got[None].lang_pred == "fr" and got[705].lang_pred == "en"
    assert got[704].lang_pred in TALE and got[704].cross_entropy > got[703].cross_entropy
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_is_learned_from_held_out_rows(spark, speech):
    rows = [r for r in speech if r[0] is not None]
    learn = pu.fold_of(F.col("doc_id")) != 2
    turned = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    a, b = (sorted(map(tuple, langid.identify_languages(spark.createDataFrame(r, "doc_id long, text string, lang string"), learn=learn).collect())) for r in (rows, turned))
    assert a == b


def test_without_labels_every_language_is_unknown(spark):
    df = spark.createDataFrame([(1, "hello", None), (2, "...", "en")], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify_languages(df, learn=F.lit(True)).collect()] == [("und", 0.0)] * 2
    assert langid.identify_languages(df.where("false"), learn=F.lit(True)).collect() == []


# --- conversations


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(c - math.fmod(c, 20), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1]) if p else [])
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in range(-20, n):
        if c % 17 == 5:
            continue
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["yes", "no way", "a b\tc", ""])))
    rows += [(7, None, "user", "first"), (7, None, None, None), (9, 3, "bot", "twice"), (9, 3, "bot", "twice"), (None, 1, "user", "nobody")]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1060) for t in range(6)]  # copies
    rows += [(2000, t, "user", f"long {t % 7}") for t in range(1500)] + [(2001, t, "user", f"long {t % 7}") for t in range(1400)] + [(2002, 1, "user", "x")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "IDS_CHARS", 40)
    rows = made(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, owner string").repartition(6)
    got = sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=str)
    assert got == brute_trie(rows)


def test_trie_of_an_empty_table(spark):
    assert trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_a_whole_phrase_has_the_hash_of_its_place_in_a_text():
    import pyarrow as pa

    from quarryline.llm.common import flat_text, hash_words

    langs, texts = pa.array(["en", "de"]), pa.array(["One two  THREE four. five", "a b, c d e f g"])
    data, offs = flat_text(langs)
    t = collocations.Phrases(*flat_text(texts), hash_words(data, offs[:-1], offs[1:]))
    for k in (1, 2, 3, 5):
        for i in np.flatnonzero(t.starts(k)):
            lang, phrase = flat_text(pa.array([langs[int(t.row[i])].as_py()])), flat_text(pa.array([t.phrase(int(i), k)]))
            assert collocations.phrase_hashes(*lang, *phrase)[0] == t.hashes(k)[i]


def test_the_scan_deals_the_texts_to_few_shards_at_a_time(spark, monkeypatch):
    from quarryline.llm import collocations

    monkeypatch.setattr(collocations, "SHARD_BYTES", 60)
    monkeypatch.setattr(collocations, "BLOCK_PATTERNS", 2)
    waves, plain = [], collocations.materialize
    monkeypatch.setattr(collocations, "materialize", lambda df, name: waves.append(name) or plain(df, name))
    docs = spark.createDataFrame([("x", " ".join(f"w{i} w{i + 1}" for i in range(30)))] * 3, "lang string, text string")
    phrases = spark.createDataFrame([("x", f"w{i} w{i + 1}") for i in range(30)], "lang string, phrase string")
    counts = {r.phrase: r.n for r in collocations.count_phrases(docs, phrases).collect()}
    assert waves.count("vectors") >= 3 and counts == {"": 180} | {f"w{i} w{i + 1}": 3 for i in range(30)}


def test_every_label_is_learned(spark):
    label = lambda i: f"l{i:03d}"
    said = lambda i, j: " ".join(chr(0x4E00 + 20 * i + (j * k + k) % 20) * 2 for k in range(1, 12))
    rows = [(140 * j + i, said(i, j), label(i)) for j in range(8) for i in range(140) if j < 6 or i < 100]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r.lang_pred for r in langid.identify_languages(df, learn=F.lit(True)).collect()}
    assert [i for i, _, la in rows if got[i] != la] == []


def test_blocks_of_languages_answer_as_one_model():
    rng = random.Random(3)
    grams = []
    for lang in range(5):
        codes = np.unique(np.array([[rng.randint(97, 103 + lang) for _ in range(4)] for _ in range(60)], np.uint32), axis=0)
        grams.append((codes, np.array([rng.randint(1, 5) for _ in codes])))
    texts = ["abc dea fgh", "zzz aab", "", "abcdefghij"]
    one, parts = langid.KneserNey(grams).cross_entropy(texts), langid.Models(grams, 2).cross_entropy(texts)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(one, parts, strict=True))
