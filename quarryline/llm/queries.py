"""One query for each training-data operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import collocations, hilbert, jump, langid, lines, mixing, mlm, ngram_join, packing, pu, substring, trie, wavelet
from quarryline.llm.common import spread, table


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = wavelet.new_folder(spark)
    return wavelet.read_wavelet_shards(folder, wavelet.write_wavelet_shards(spread(table(spark, sf_dir, "documents")), folder))


def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mlm.pseudo_likelihood(spread(table(spark, sf_dir, "documents")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_digest(spread(table(spark, sf_dir, "documents")))


def op4_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump.shard_documents(table(spark, sf_dir, "documents"), 8)


def op5_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = lines.line_verdicts(lines.measure_texts(spread(table(spark, sf_dir, "documents"))))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def op6_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spread(table(spark, sf_dir, "documents")), keep_ids=False)


def op7_token_combination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(spread(table(spark, sf_dir, "documents")))


def op8_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = pu.quality_scores(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"), learn=pu.fold_of(F.col("doc_id")) != 2)
    held = F.coalesce(pu.fold_of(F.col("doc_id")) == 2, F.lit(False))
    return scores.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.poisson_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.col("mix_count").cast("long").alias("n_copies"), F.col("mix_copy").cast("long").alias("copy"), F.round("mix_key", 12).alias("order_key"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op10_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.hilbert_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(spread(table(spark, sf_dir, "documents")))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify_languages(spread(table(spark, sf_dir, "documents")), learn=pu.fold_of(F.col("doc_id")) != 2)
    held = F.coalesce(pu.fold_of(F.col("doc_id")) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_wavelet_tokens, op2_pseudo_likelihood, op3_substring_dedup, op4_jump_hash_shards, op5_line_frequency_rules,
            op6_ffd_packing, op7_token_combination_join, op8_pu_quality, op9_poisson_mixing, op10_hilbert_neighbours,
            op11_phrase_collocations, op12_language_id, op13_prefix_trie, pipeline,
        )
    }


#: Base figures and verdict of operator 5: lines by host and distinct text, over a tenth of the host's texts (5 at least, 100 at most), the host's first document excepted.
_LINES = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, row_number() OVER () AS rid,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), tri AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT t.rid, unnest([i, i + 1, i + 2]) AS p FROM tri t JOIN (SELECT rid, g FROM tri GROUP BY rid, g HAVING count(*) > 1) USING (rid, g)
  ) GROUP BY rid
), ln AS (
  SELECT rid, doc_id, host, text, l, array_to_string(list_transform(regexp_extract_all(l, '[^\x20\x09-\x0D]+'),
         lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), ' ') AS k,
         len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS lw
  FROM (SELECT rid, doc_id, host, text, unnest(string_split(text, chr(10))) AS l FROM d)
), dup AS (
  SELECT rid, count(*) - count(DISTINCT l) AS n FROM ln WHERE k <> '' GROUP BY rid
), often AS (
  SELECT host, k, min(doc_id) AS first FROM ln JOIN (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host) USING (host)
  WHERE k <> '' GROUP BY host, k, docs HAVING count(DISTINCT text) > least(100, greatest(5, 0.1::DOUBLE * docs))
), gone AS (
  SELECT rid, sum(lw) AS n FROM ln JOIN often USING (host, k) WHERE doc_id <> first GROUP BY rid
), base AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.3 * n_words AS kept, n_removed_words
FROM base
"""

_SUBSTRING = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)
), hit AS (
  SELECT doc_id, i FROM win JOIN (SELECT g, min(doc_id) AS first FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)) USING (g) WHERE doc_id > first
), cov AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM hit
), one AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w
), kept AS (
  SELECT one.doc_id, string_agg(x, ' ' ORDER BY one.i) AS t, count(*) AS n FROM one ANTI JOIN cov ON one.doc_id = cov.doc_id AND one.i = cov.i GROUP BY one.doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


#: Operator 4: the walk of jump hashing (a walk that has ended at b is kept as -b - 1), slots by a hash, and crc32 byte by byte.
_JUMP = r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS i)
  )
), d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT + 1 AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32, coalesce(doc_id::VARCHAR, 'null') AS k
  FROM documents, tab
), w AS (
  SELECT *, {eight} AS s8, {nine} AS s9 FROM d
), p AS (
  SELECT *, CASE WHEN s8 < 0 THEN -s8 - 1 ELSE s8 END AS shard, CASE WHEN s9 < 0 THEN -s9 - 1 ELSE s9 END AS grown,
         ('0x' || substr(md5(k || ':' || text_crc32::VARCHAR), 1, 8))::BIGINT % 256 AS part
  FROM w
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY part, doc_id, text_crc32, size) - 1 AS slot, grown::INTEGER AS grown_shard
FROM p
"""


def _jump_sql() -> str:
    def walk(shards: int) -> str:
        to = "floor((b + 1)::DOUBLE / ((('0x' || substr(md5(k || ':' || b::VARCHAR), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496.0))"
        step = f"CASE WHEN b < 0 THEN b WHEN {to} >= {shards} THEN -b - 1 ELSE {to}::BIGINT END"
        return f"list_reduce(list_prepend(0::BIGINT, range({shards})), lambda b, _: {step})"

    return _JUMP.replace("{eight}", walk(8)).replace("{nine}", walk(9))


#: Operator 7: all pairs that share a shingle, and what is reachable by links.
_JOIN = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), sym AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT doc_id, doc_id AS t FROM d UNION SELECT r.doc_id, sym.b FROM r JOIN sym ON r.t = sym.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d JOIN (SELECT doc_id, min(t) AS component_id FROM r GROUP BY doc_id) c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


#: Operator 11: all phrases of up to five words within pieces; products as HUGEINT.
_PHRASES = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(q, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS q
    FROM documents
  )
), tot AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang
), f AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a, any_value(w[i:i + m - 1]) AS g
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)
  GROUP BY lang, m, phrase HAVING count(*) >= 100
), cut AS (
  SELECT lang, phrase, a, k, array_to_string(g[1:k], ' ') AS one, array_to_string(g[k + 1:m], ' ') AS two
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1)
), sc AS (
  SELECT cut.*, x.a AS l, y.a AS r, n, ((1000::HUGEINT * cut.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = one JOIN f y ON y.lang = cut.lang AND y.phrase = two JOIN tot ON tot.lang = cut.lang
), best AS (
  SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT DISTINCT s.lang, s.phrase FROM (SELECT lang, a, unnest([array_to_string(g[1:m - 1], ' '), array_to_string(g[2:m], ' ')]) AS phrase FROM f WHERE m > 2) s
  JOIN f USING (lang, phrase) WHERE 100 * s.a >= 100 * f.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM best ANTI JOIN inside USING (lang, phrase) QUALIFY rank <= 2000
"""

#: Operator 13: every prefix as the md5 of its turns; a node's subtree is the nodes whose least member has the node's prefix.
_TRIE = r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS tb FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS i)
  )
), t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS j
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base FROM t GROUP BY conv_id
), c AS (
  SELECT n.conv_id, n.n, n.base, least(h, coalesce(b.n, 0)) AS m, h FROM (
    SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda y: ('0x' || y)::BIGINT)),
      lambda a, y: xor(a >> 8, tb[(xor(a, y) & 255) + 1])), 4294967295) % 4 AS h FROM n, tab
  ) n LEFT JOIN (SELECT conv_id AS b_id, n FROM n) b ON b.b_id = n.base
), e AS (
  SELECT c.conv_id, m + j - h AS d, r, x FROM t JOIN c USING (conv_id) WHERE j > h
  UNION ALL SELECT c.conv_id, j AS d, r, x FROM c JOIN t ON t.conv_id = c.base WHERE j <= h
), p AS (
  SELECT conv_id, d, md5(string_agg(md5(r) || md5(x), '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM e
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
), g AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, min(w) AS w FROM p GROUP BY d, k
), up AS (
  SELECT g.*, q.k AS uk FROM g LEFT JOIN p q ON q.conv_id = g.conv_id AND q.d = g.d - 1
), kids AS (
  SELECT d - 1 AS d, uk AS k, count(*) AS kids FROM up WHERE d > 0 GROUP BY ALL
), node AS (
  SELECT up.*, coalesce(kids, 0) AS kids FROM up LEFT JOIN kids USING (d, k)
), sub AS (
  SELECT a.d, a.k, sum((y.kids = 0)::INT) AS leaves, sum((y.n - 1) * y.w) AS saved
  FROM node a JOIN p ON p.d = a.d AND p.k = a.k JOIN node y ON y.conv_id = p.conv_id AND y.d >= a.d GROUP BY ALL
), fin AS (
  SELECT d, k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS s FROM (SELECT conv_id, max(d) AS d, max_by(k, d) AS k FROM p GROUP BY conv_id) GROUP BY d, k
)
SELECT node.conv_id, node.d::BIGINT AS depth, o.conv_id AS parent_conv_id, node.n::BIGINT AS n_convs, node.kids::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(s, sha256('')) AS ends_sha256
FROM node JOIN sub USING (d, k) LEFT JOIN fin USING (d, k) LEFT JOIN g o ON o.d = node.d - 1 AND o.k = node.uk
"""


def _poisson_sql(seed: int = 9) -> str:
    # Means of at most 16 need one part; larger ones are split, part i > 1 drawing from the draw and i.
    return f"""
WITH s AS (SELECT source, sum(coalesce(strlen(text), 0) + 1)::BIGINT AS size FROM documents GROUP BY source),
t AS (SELECT source, (SELECT sum(size) FROM s) * (sqrt(size::DOUBLE) / (SELECT sum(sqrt(size::DOUBLE)) FROM s)) / size AS rate FROM s),
d AS (
  SELECT doc_id, s.source, md5(coalesce(text, '')) AS text_md5, rate,
         ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents s JOIN t ON s.source IS NOT DISTINCT FROM t.source
),
c AS (
  SELECT doc_id, source, text_md5, list_reduce(list_prepend({{'term': exp(-rate), 'cdf': exp(-rate), 'n': 0::BIGINT, 'k': 0::BIGINT}},
      list_transform(range(1, 81), lambda k: {{'term': 0.0::DOUBLE, 'cdf': 0.0::DOUBLE, 'n': 0::BIGINT, 'k': k}})),
    lambda a, b: {{'term': a.term * rate / b.k, 'cdf': a.cdf + a.term * rate / b.k, 'n': a.n + (u >= a.cdf)::BIGINT, 'k': b.k}}).n AS n_copies
  FROM d
),
e AS (SELECT doc_id, source, text_md5, n_copies, unnest(range(n_copies)) AS copy FROM c WHERE n_copies > 0)
SELECT doc_id, source, n_copies, copy, text_md5,
  round(('0x' || substr(md5('{seed}:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0, 12) AS order_key
FROM e
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": _SUBSTRING, "op4_jump_hash_shards": _jump_sql(), "op7_token_combination_join": _JOIN, "op5_line_frequency_rules": _LINES, "op9_poisson_mixing": _poisson_sql(), "op11_phrase_collocations": _PHRASES, "op13_prefix_trie": _TRIE}
