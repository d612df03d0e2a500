"""DuckDB SQL for those training-data queries that SQL can express on whole tables."""

from __future__ import annotations

W = r"'[^\x20\x09-\x0D]+'"
LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES: dict[str, str] = {}

ORACLES["op2_exact_top_k"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vec
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.vec, c.vec),
    lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""

ORACLES["op6_ngram_jaccard"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce({LOW}, ''), {W}) AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5
    THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3),
    lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
one AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id FROM s JOIN (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = s.doc_id"""

ORACLES["op7_repeated_bytes"] = """
WITH h AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
grams AS MATERIALIZED (
  SELECT doc_id, i, md5(substring(h, 2 * i + 1, 400)) AS g
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM h)),
again AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM grams
  JOIN (SELECT g FROM grams GROUP BY g HAVING count(*) > 1) USING (g)),
islands AS (
  SELECT doc_id, n, min(i) AS first, max(i) + 200 AS stop FROM (SELECT *, sum(
    (before IS NULL OR i > before + 200)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM again)
  GROUP BY doc_id, n),
gaps AS (
  SELECT doc_id, n, first, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY n), 0) AS since
  FROM islands),
kept AS (
  SELECT h.doc_id, count(*) AS spans, sum(stop - first)::BIGINT AS removed,
    string_agg(substring(h, 2 * since + 1, 2 * (first - since)), '' ORDER BY n)
      || substring(any_value(h), 2 * max(stop) + 1) AS k
  FROM gaps JOIN h USING (doc_id) GROUP BY h.doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed,
  coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM h LEFT JOIN kept USING (doc_id)"""

ORACLES["op9_source_mix"] = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {W})), 0)::BIGINT AS size,
    ('0x' || md5('0:' || coalesce(doc_id::VARCHAR, ''))[1:12])::BIGINT / 281474976710656.0::DOUBLE AS draw
  FROM documents),
s AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap FROM (SELECT source, sum(size)::BIGINT AS source_size,
    ([3.0, 1.0, 2.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
    FROM d GROUP BY source)),
levels AS (
  SELECT cap / weight AS ratio, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (
      ORDER BY cap / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
t AS (
  SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, ratio) FROM levels
    WHERE level <= ratio)) AS target FROM s)
SELECT doc_id, size, source_size, target, size * (floor(rate)
  + (draw < rate - floor(rate))::INT)::BIGINT AS taken
FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)"""

_KEY = (r"trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        r"'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'))")
ORACLES["op10_quality_rules"] = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, text, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {W}) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {W})) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
repeats AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM windows
    JOIN (SELECT doc_id, g FROM windows GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g))
  GROUP BY doc_id),
lines AS MATERIALIZED (
  SELECT doc_id, source, text, {_KEY} AS k, len(regexp_extract_all(x, {W})) AS n
  FROM (SELECT doc_id, source, text, unnest(lines) AS x FROM d)),
common AS (
  SELECT source, k FROM lines GROUP BY source, k HAVING count(DISTINCT text) >= 10),
shared AS (
  SELECT doc_id, sum(l.n)::BIGINT AS n FROM lines l JOIN common c
    ON l.k = c.k AND l.source IS NOT DISTINCT FROM c.source GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w,
      lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, coalesce(c.n, 0) AS n_common_words
  FROM d LEFT JOIN repeats r USING (doc_id) LEFT JOIN shared c USING (doc_id))
SELECT *, NOT base_failed AND n_words - n_common_words >= n_words * 0.5::DOUBLE AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)"""

ORACLES["op11_sketch_near_duplicates"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce({LOW}, ''), {W}) AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)),
    lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
one AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x)
SELECT *, doc_id = component_id AS kept FROM (
  SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id FROM s JOIN (
    SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = s.doc_id)"""

#: CRC-32 of a list of bytes: the table follows from the polynomial.
_TABLE = """SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab"""
_CRC = """xor(list_reduce(list_concat([4294967295], {bytes}),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"""

ORACLES["op12_prefix_trie"] = f"""
WITH tab AS MATERIALIZED ({_TABLE}),
own AS MATERIALIZED (
  SELECT conv_id, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (
  SELECT conv_id, own, {_CRC.format(bytes="list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 9 AS h
  FROM own, tab),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(list_slice(b.own, 1, a.h), []), list_slice(a.own, a.h + 1, len(a.own))) AS seq
  FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
prefixes AS (
  SELECT conv_id, d, list_slice(seq, 1, d) AS k, len(seq) = d AS ends
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)),
nodes AS MATERIALIZED (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(
    string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY k, d),
children AS MATERIALIZED (
  SELECT list_slice(k, 1, d - 1) AS pk, d - 1 AS pd, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
known AS MATERIALIZED (
  SELECT nodes.*, coalesce(n, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE strlen(k[d].x) END AS bytes
  FROM nodes LEFT JOIN children ON k = pk AND d = pd),
sums AS (
  SELECT a.k AS ak, a.d AS ad, sum((b.n_children = 0)::INT) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved
  FROM known a JOIN known b ON b.d >= a.d AND list_slice(b.k, 1, a.d) = a.k GROUP BY a.k, a.d)
SELECT c.conv_id, c.d::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs::BIGINT AS n_convs,
  c.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, c.ends_sha256
FROM known c JOIN sums ON c.k = ak AND c.d = ad
LEFT JOIN nodes p ON c.d > 0 AND p.d = c.d - 1 AND p.k = list_slice(c.k, 1, c.d - 1)"""

_BYTES = """list_transform(range(0, len(hx) // 2), lambda i: ('0x' || substring(hx, 2 * i + 1, 2))::BIGINT)"""
ORACLES["op13_spelling_variants"] = f"""
WITH RECURSIVE tab AS MATERIALIZED ({_TABLE}),
runs AS MATERIALIZED (
  SELECT run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx, n FROM (
    SELECT doc_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS x FROM documents)
    WHERE length(x) >= 7 GROUP BY ALL)),
coded AS (SELECT run, n, {_CRC.format(bytes=_BYTES)} AS h FROM runs, tab),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substring(run, 1, h % length(run))
    || substring(run, h % length(run) + 2) ELSE run END AS word FROM coded)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (
  SELECT word, n, j, substring(word, 1, j - 1) || substring(word, j + 1) AS k
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS j FROM words)),
one_less AS (SELECT DISTINCT c.word AS long, c.n AS long_n, w.word AS short, w.n AS short_n FROM cut c JOIN words w ON c.k = w.word),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.j = b.j AND a.k = b.k AND a.word <> b.word
  UNION ALL SELECT long, short, short_n FROM one_less UNION ALL SELECT short, long, long_n FROM one_less),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n
  FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form,
    CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)),
walk(word, last, next) AS (
  SELECT word, word, form FROM forms
  UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN forms f ON w.next = f.word)
SELECT word, form, last AS root, n, n_near, form_n FROM forms JOIN (
  SELECT word, last FROM walk WHERE next IS NULL) USING (word)"""
