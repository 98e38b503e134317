"""DuckDB SQL for the registered queries that SQL can express. Patterns are the plain ones, written for its own engine."""

# Every match of a pattern with its position: lengths of the pieces between matches are summed up.
_POSITIONS = """
{name}_m AS (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g FROM docs WHERE regexp_matches(t, '{pattern}')),
{name} AS (
  SELECT doc_id, m[i] AS value,
         CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM {name}_m))"""


def positions(name: str, pattern: str) -> str:
    return _POSITIONS.format(name=name, pattern=pattern.replace("'", "''"))


_KEYWORD = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
_HEAD = _KEYWORD + r"""["']?\x20*[:=]\x20*["']?"""

SECRETS = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{positions("assign", _HEAD + "([A-Za-z0-9+/_.=-]+)")},
{positions("access", "AKIA[A-Z0-9]+")},
{positions("hexes", "[0-9a-f]{20,}")},
{positions("cand", "[A-Za-z0-9+/_=-]{20,}")},
base AS (
  SELECT doc_id, s, 0 AS rank, 'assign' AS kind, s + length(value) AS e FROM assign
  WHERE length(regexp_replace(value, '^{_HEAD.replace("'", "''")}', '')) >= 8
  UNION ALL SELECT doc_id, s, 1, 'access', s + length(value) FROM access WHERE length(value) >= 16
  UNION ALL SELECT doc_id, s, 2, 'hex', s + length(value) FROM hexes WHERE length(value) >= 32),
suspects AS (
  SELECT doc_id, s, value, CASE WHEN regexp_matches(value, '^([0-9a-f]+|[0-9A-F]+)$') THEN 2.95
           WHEN regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') THEN 3.83 ELSE 3.52 END AS bound
  FROM cand
  WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND NOT regexp_matches(value, '^[0-9A-Fa-f]{{8}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{12}}$')
    AND NOT regexp_matches(lower(value), '^(md5|sha1|sha256|sha384|sha512)-')
    AND NOT regexp_matches(lower(value), 'example|sample|placeholder|dummy|changeme|your[_-]|abcdefghij|0123456789|1234567890|qwertyuiop')
    AND NOT regexp_matches(value, '^([0-9]+[-/_=+]?)+$') AND NOT regexp_matches(value, '^([A-Za-z]+[-/_=+]*)+$')),
win AS (
  SELECT doc_id, s, value, i FROM (SELECT *, unnest(range(0, length(value) - 19)) AS i FROM suspects)
  WHERE list_aggregate(string_split(substr(value, CAST(i + 1 AS BIGINT), 20), ''), 'entropy') >= bound),
runs AS (
  SELECT doc_id, s + min(i) AS s, s + max(i) + 20 AS e
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, s ORDER BY i) AS run
        FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, s ORDER BY i) < 20 THEN 0 ELSE 1 END AS fresh FROM win))
  GROUP BY doc_id, s, run),
spans AS (
  SELECT * FROM base
  UNION ALL SELECT doc_id, s, 3, 'entropy', e FROM runs r
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.s < r.e AND r.s < b.e))
SELECT docs.doc_id,
       count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank), '') AS spans
FROM docs LEFT JOIN spans ON docs.doc_id = spans.doc_id
GROUP BY docs.doc_id
"""

NEAR_TEXT = """
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM docs),
copies AS (SELECT doc_id, len(s) AS n, min(doc_id) OVER (PARTITION BY list_sort(s)) AS class FROM sets),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets WHERE doc_id IN (SELECT class FROM copies WHERE n > 0)),
linked AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT DISTINCT a AS doc_id, a AS r FROM both_ways UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON r = a),
least AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT copies.doc_id, n AS n_shingles, CASE WHEN n = 0 THEN copies.doc_id ELSE coalesce(r, class) END AS component_id,
       copies.doc_id = CASE WHEN n = 0 THEN copies.doc_id ELSE coalesce(r, class) END AS kept
FROM copies LEFT JOIN least ON class = least.doc_id
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS MATERIALIZED (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND list_sum(list_transform(e, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0
         AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
linked AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT DISTINCT a AS vec_id, a AS r FROM linked UNION SELECT reach.vec_id, b FROM reach JOIN linked ON r = a),
least AS (SELECT vec_id, min(r) AS r FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM linked GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, coalesce(r, v.vec_id) AS component_id, v.vec_id = coalesce(r, v.vec_id) AS kept
FROM v LEFT JOIN counts ON v.vec_id = counts.vec_id LEFT JOIN least ON v.vec_id = least.vec_id
"""

# Fixed values of the rules: 2 of 100 over 5 rules, 5 of 100 over strata and rules.
QUALITY_RULES = """
WITH docs AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, l),
dups AS (SELECT doc_id, sum(n) AS n_lines, sum(n - 1) AS n_dup FROM lines GROUP BY doc_id),
win AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM docs)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
reps AS (SELECT doc_id, count(DISTINCT i + d) AS n_rep FROM again, (SELECT unnest(range(5)) AS d) GROUP BY doc_id),
counts AS (
  SELECT doc_id, lang, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(len(regexp_extract_all(t, '[A-Z]')) AS BIGINT) AS n_upper, CAST(len(regexp_extract_all(t, '!')) AS BIGINT) AS n_shouts
  FROM docs LEFT JOIN dups USING (doc_id) LEFT JOIN reps USING (doc_id)),
marks AS (SELECT doc_id, min(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
cuts AS (SELECT unnest([900, 700, 500, 400, 300, 200, 150, 100, 70, 50]) AS cut),
ratios AS (
  SELECT doc_id, lang, unnest([1, 2, 3, 4, 5]) AS rule, unnest([n_symbols, n_dup_lines, n_repeat_words, n_upper, n_shouts]) AS a,
         unnest([word_chars, n_lines, n_words, word_chars, n_words]) AS b FROM counts),
tests AS (
  SELECT lang, rule, cut, count(*) AS n, count(*) FILTER (1000 * a > cut * b) AS k
  FROM ratios JOIN marks USING (doc_id), cuts WHERE good = 1 GROUP BY lang, rule, cut),
tails AS (
  SELECT *, CASE WHEN k >= n * 0.004 THEN 1 ELSE list_sum(list_transform(range(0, k + 1),
           lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.004) + (n - i) * ln(0.996)))) END AS p FROM tests),
allowed AS (SELECT 0.05 / (5 * greatest(count(DISTINCT coalesce(lang, ' null')), 1)) AS e FROM tails),
proven AS (SELECT lang, rule, min(cut) FILTER (ok) AS cut FROM (
  SELECT lang, rule, cut, bool_and(p <= e) OVER (PARTITION BY lang, rule ORDER BY cut DESC) AS ok FROM tails, allowed) GROUP BY lang, rule),
rejected AS (SELECT DISTINCT doc_id FROM ratios r JOIN proven p ON r.lang IS NOT DISTINCT FROM p.lang AND r.rule = p.rule WHERE 1000 * a > cut * b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM counts
"""

# Every two equal words of a text at most a third of it apart; stretches of such pairs are islands of their lag. 3988292384 is the fixed polynomial of CRC-32.
PERIODIC = """
WITH sums AS (
  SELECT doc_id, coalesce(text, '') AS t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) AS h
  FROM documents),
docs AS (SELECT doc_id, h, h // 10 AS g, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM sums),
places AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM docs),
periods AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM places),
words AS MATERIALIZED (
  SELECT doc_id, n, i, CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS w FROM (SELECT *, unnest(range(n)) AS i FROM periods)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS l FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM runs)),
rest AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT docs.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(l, '')) AS runs_sha256, sha256(coalesce(rest.t, '')) AS collapsed_sha256
FROM docs LEFT JOIN lines USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN rest USING (doc_id)
"""


def centroids(rounds: int) -> str:
    """Plain rounds, one after the other: assign all vectors, then move all centroids."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(x) AS x, min(struct_pack(d := d, c := c)) AS best FROM (
    SELECT v.vec_id, v.x, c.c, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS BIGINT) AS d FROM v, c{r} c) GROUP BY vec_id),""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
    SELECT best.c AS c, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY best.c, i) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c),""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 8)),{"".join(steps)}
done AS (SELECT vec_id, best.c AS c, best.d AS d FROM a{rounds})
SELECT vec_id, CAST(done.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY done.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
FROM done JOIN c{rounds} ON done.c = c{rounds}.c
"""


CENTROIDS = centroids(10)
