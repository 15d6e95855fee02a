"""run() holds against the stages done one by one in plain Python on a small table."""

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict

import corpus_pipeline
from quarryline.llm.tokens import public_path


def test_stages_and_result(spark, tmp_path):
    rng = random.Random(11)
    vocab = [f"word{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = text(60)
    rows = [(i, text(100)) for i in range(30)]
    rows += [(100, rows[3][1]), (101, rows[4][1] + " extra"), (102, text(60) + "\n" + passage), (103, text(70) + "\n" + passage), (104, "short one"), (105, None), (None, text(90))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path)).cache()
        assert left.columns == docs.columns
        seen[name] = {r.doc_id: r.text for r in left.collect()}
    assert set(seen["quality_rules"]) == {i for i, _ in rows} - {104, 105}
    assert set(seen["near_duplicates"]) == set(seen["quality_rules"]) - {100, 101}
    assert seen["repeated_passages"][102] == seen["near_duplicates"][102]
    assert len(seen["repeated_passages"][103].split()) == 70
    ids = [r.doc_id for r in left.collect()]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == Counter(ids)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_near_duplicates_take_scattered_edits(spark):
    """Two changed words of 100: 0.81 by five-word shingles, 0.885 by three-word ones."""
    rng = random.Random(12)
    base = [f"word{rng.randrange(3000)}" for _ in range(100)]
    copy, other = list(base), list(base)
    copy[30], copy[70] = "changed", "altered"
    other[20], other[50], other[80] = "one", "two", "three"
    rows = [(1, base), (2, copy), (3, other), (4, [f"else{i}" for i in range(100)])]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3, 4}


def test_near_duplicates_take_repeated_rows_and_copies_without_an_id(spark):
    rng = random.Random(13)
    a, b, c, d = (" ".join(f"word{rng.randrange(3000)}" for _ in range(100)) for _ in range(4))
    rows = [(1, a), (1, a), (2, b), (None, b), (None, b + " extra"), (None, c), (None, c), (None, c + " extra"), (None, d), (5, None), (5, "other text"), (1, "more under a used id")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    left = corpus_pipeline.near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    left = Counter((r.doc_id, r.text) for r in left.collect())
    one = [(None, c), (None, c + " extra")]
    assert sum(left.pop(k, 0) for k in one) == 1
    assert left == Counter([(1, a), (2, b), (None, d), (5, None), (5, "other text"), (1, "more under a used id")])


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


def plain_rules(rows):
    """Rows (id, text, source) that stay, without the lines above their host's limit."""
    texts, having, first = defaultdict(set), defaultdict(set), {}
    key = lambda line: " ".join(WORD.findall(lowered(line)))
    for i, t, s in rows:
        texts[s].add(t)
        for line in {key(x) for x in t.split("\n")} - {""}:
            having[s, line].add(t)
            first[s, line] = min(first.get((s, line), i), i)
    out = []
    for i, t, s in rows:
        w = WORD.findall(t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        limit = min(100, max(5, 0.1 * len(texts[s])))
        kept = [x for x in t.split("\n") if not key(x) or len(having[s, key(x)]) <= limit or first[s, key(x)] == i]
        left = len(WORD.findall("\n".join(kept)))
        if len(w) >= 50 and 100 * len(again) <= 50 * len(w) and left >= 0.3 * len(w):
            out.append((i, "\n".join(kept), s))
    return out


def plain_duplicates(rows):
    def shingles(t):
        w = WORD.findall(lowered(t))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets, group = {i: shingles(t) for i, t, _ in rows}, {i: i for i, *_ in rows}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if g == old else g for k, g in group.items()}
    return [r for r in rows if group[r[0]] == r[0]]


def plain_repeats(rows):
    first, out = {}, []
    for i, t, _ in sorted(rows):
        w = WORD.findall(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, t, s in rows:
        spans = [m.span() for m in WORD.finditer(t)]
        w = [t[a:b] for a, b in spans]
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        if gone:
            parts = [t[(spans[j - 1][1] if j else 0) : spans[j][1]] for j in range(len(w)) if j not in gone]
            t = "".join(parts).strip()
        if t:
            out.append((i, t, s))
    return out


def plain_mix(rows, seed=9):
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.encode()) + 1
    roots = {s: math.sqrt(n) for s, n in size.items()}
    out = []
    for i, t, s in rows:
        rate = sum(size.values()) * roots[s] / sum(roots.values()) / size[s]
        assert rate <= 16
        u = int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        term = total = math.exp(-rate)
        n = 0
        while u >= total:
            n += 1
            term *= rate / n
            total += term
        out += [(i, t, s)] * n
    return out


def test_run_equals_plain_python(spark, tmp_path):
    rng = random.Random(21)
    vocab = [f"Word{i}" + rng.choice(["", ",", ".", "é"]) for i in range(2500)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passages, rows = [text(40) for _ in range(4)], []
    for i in range(150):
        parts = [text(rng.randint(30, 120))]
        if i % 4 == 0:
            parts.append("Follow us  for MORE like this")
        if i % 7 == 0:
            parts.insert(rng.randint(0, 1), rng.choice(passages) + "\t" + text(5))
        if i % 11 == 0:
            parts = ["say it again and again " * 20]
        if i and i % 9 == 0:
            parts = [rows[rng.randrange(len(rows))][1] + rng.choice(["", " tail", "\nend of it"])]
        rows.append((i, "\n".join(parts), rng.choice(["a", "a", "a", "b", "c"])))
    rows.append((200, "\n".join(text(12) for _ in range(300)), "c"))
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    stages = [plain_rules(rows)]
    for step in (plain_duplicates, plain_repeats, plain_mix):
        stages.append(step(stages[-1]))
    assert [len(rows), *map(len, stages[:3])] == sorted([len(rows), *map(len, stages[:3])], reverse=True) and len(stages[1]) < len(stages[0]) < len(rows)
    assert any(a[1] != b[1] for a, b in zip(sorted(stages[1]), sorted(stages[2]), strict=False))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    want = Counter()
    for i, t, _ in stages[3]:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        want.update((i, k, struct.pack(f"<{len(ids[k : k + 2048])}I", *ids[k : k + 2048])) for k in range(0, len(ids), 2048))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, bytes(r.ids)) for r in out) == want
    fill = defaultdict(list)
    for r in out:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(n for parts in fill.values() for _, n in parts)
    assert len(fill) <= 1.1 * total / 2048 + 2


def test_run_on_an_empty_table_and_clashing_names(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, found string, mix_key int, component_id int, removed string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, long, "en", "s", 1, "f", 7, 8, "r"), (2, None, None, None, None, None, None, None, None), (3, "", "en", None, 0, "f", 7, 8, "r"), (4, " ".join(f"v{i}" for i in range(80)), "en", None, 1, None, None, None, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    left = spark.read.parquet(f"{tmp_path}/b/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, f"{tmp_path}/b")
        assert left.columns == [f.split()[0] for f in schema.split(", ")]
    assert {r.doc_id: r.mix_key for r in left.collect()}.items() <= {1: 7, 4: None}.items()
    out = corpus_pipeline.run(spark, f"{tmp_path}/b").collect()
    assert {r.doc_id for r in out} <= {1, 4}
