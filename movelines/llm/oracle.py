"""DuckDB SQL for the corpus queries that it can express on whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS words FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS seq FROM (SELECT *, unnest(generate_series(1, len(words) - 12)) AS i FROM w)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY seq) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM late),
dropped AS (SELECT doc_id, list(i) AS places, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
    sha256(coalesce(array_to_string(CASE WHEN places IS NULL THEN words ELSE list_filter(words, lambda x, k: NOT list_contains(places, k)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN dropped USING (doc_id)"""

OP3 = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
    WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(e) > 0),
good AS MATERIALIZED (SELECT * FROM v WHERE n > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON vec_id = least.a LEFT JOIN n ON vec_id = n.a"""

OP8 = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS MATERIALIZED (SELECT source, sz, 3.0::DOUBLE * sz AS cap, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM (SELECT source, CAST(sum(size) AS BIGINT) AS sz FROM d GROUP BY source)),
-- each round clamps the sources that the level puts above their caps
fill AS (SELECT 0 AS round, (SELECT CAST(sum(sz) AS DOUBLE) / sum(w) FROM s) AS level UNION ALL
    SELECT round + 1, (SELECT (sum(sz) - coalesce(sum(cap) FILTER (cap < f.level * w), 0)) / nullif(sum(w) FILTER (cap >= f.level * w), 0) FROM s) FROM fill f
    WHERE round < (SELECT count(*) FROM s) AND f.level IS NOT NULL),
t AS (SELECT source, sz, least(cap, coalesce((SELECT arg_max(level, round) FROM fill WHERE level IS NOT NULL) * w, cap)) AS target FROM s),
e AS (SELECT *, CASE WHEN sz > 0 THEN floor(target / sz) ELSE 0 END AS whole FROM t),
g AS (SELECT *, CAST(round(target - whole * sz) AS BIGINT) AS more FROM e),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, size, sz AS source_size, target, CAST(whole * size + least(size, greatest(0, more - before)) AS BIGINT) AS taken
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source"""

OP12 = """
WITH RECURSIVE t AS MATERIALIZED (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
-- CRC-32 bit by bit over the decimal digits
bytes AS (SELECT c, [ord(x) FOR x IN string_split(CAST(c AS VARCHAR), '')] AS b FROM (SELECT DISTINCT c FROM t)),
crc AS (SELECT c, b, 0 AS i, 4294967295::BIGINT AS r FROM bytes UNION ALL
    SELECT c, b, i + 1, CASE WHEN i % 9 = 0 THEN xor(r, b[i // 9 + 1]) ELSE CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END END FROM crc WHERE i < 9 * len(b)),
h AS MATERIALIZED (SELECT c, xor(r, 4294967295) % 9 AS h FROM crc WHERE i = 9 * len(b)),
u AS (SELECT h.c, 0 AS tail, t.k, role, text FROM h JOIN t ON t.c = h.c - h.c % 5 AND t.k <= h.h UNION ALL SELECT t.c, 1, t.k, role, text FROM t JOIN h USING (c) WHERE t.k > h.h),
turns AS MATERIALIZED (SELECT c, list({'role': role, 'text': text} ORDER BY tail, k) AS seq FROM u GROUP BY c),
every AS MATERIALIZED (SELECT c, coalesce(seq, []) AS seq FROM h LEFT JOIN turns USING (c)),
pre AS MATERIALIZED (SELECT c, d, seq[1:d] AS p, len(seq) = d AS ends FROM (SELECT *, unnest(generate_series(0, len(seq))) AS d FROM every)),
node AS MATERIALIZED (SELECT p, d, min(c) AS c, count(*) AS n, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS members, (count(*) - 1) * CASE WHEN d > 0 THEN strlen(p[d].text) ELSE 0 END AS saved FROM pre GROUP BY p, d),
kids AS MATERIALIZED (SELECT p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY p[1:d - 1]),
flat AS MATERIALIZED (SELECT p, d, saved, CAST(kids.n IS NULL AS BIGINT) AS leaf FROM node LEFT JOIN kids USING (p)),
below AS (SELECT p, CAST(sum(leaf) AS BIGINT) AS leaves, CAST(sum(saved) AS BIGINT) AS saved FROM (SELECT p[1:j] AS p, leaf, saved FROM (SELECT *, unnest(generate_series(0, d)) AS j FROM flat)) GROUP BY p)
SELECT node.c AS conv_id, node.d AS depth, up.c AS parent_conv_id, node.n AS n_convs, coalesce(kids.n, 0) AS n_children, below.leaves AS n_leaves, below.saved AS saved_tokens, sha256(node.members) AS ends_sha256
FROM node JOIN below ON below.p = node.p LEFT JOIN kids ON kids.p = node.p LEFT JOIN node AS up ON node.d > 0 AND up.p = node.p[1:node.d - 1]"""


def _op13(k: int = 40, rounds: int = 5) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, best.k AS cluster, best.d AS distance FROM (SELECT r, min({{'d': CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'k': k}}) AS best FROM e, c{i} GROUP BY r))""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT cluster AS k, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, v, unnest(generate_series(1, 64)) AS j FROM a{i} JOIN e USING (r)) GROUP BY cluster, j),
m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{i} GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))""")
    joined = ",\n".join(steps)
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('2:' || vec_id) AS h, v FROM e ORDER BY h NULLS LAST, v LIMIT {k})),
{joined},
i AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS own FROM a{rounds} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, own AS cluster_inertia, (SELECT CAST(sum(distance) AS BIGINT) FROM a{rounds}) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN e USING (r) JOIN i USING (cluster) JOIN c{rounds} ON c{rounds}.k = cluster"""


def _op4() -> str:
    part = lambda v, m: f"CASE WHEN {v} > 0 THEN {v} * log2({v} / {m}) ELSE 0 END"
    term = lambda x, y: f"(({part(x, f'(({x} + {y}) / 2)')}) + ({part(y, f'(({x} + {y}) / 2)')}))"

    def distance(own: str, ref: str) -> str:
        terms = f"list_transform(list_zip({own}, {ref}), lambda z: {term(f'(z[1] / list_sum({own}))', f'(z[2] / list_sum({ref}))')})"
        return f"CASE WHEN list_sum({own}) > 0 AND list_sum({ref}) > 0 THEN sqrt(greatest(list_sum({terms}) / 2, 0)) ELSE 1.0 END"

    def quantiles(name: str, rows: str, value: str, *parts: float) -> str:
        steps = f"SELECT lang, step, sum(n) OVER (PARTITION BY lang ORDER BY step) AS below, sum(n) OVER (PARTITION BY lang) AS every FROM (SELECT lang, floor(1000 * {value}) AS step, count(*) AS n FROM {rows} GROUP BY ALL)"
        return f"{name} AS MATERIALIZED (SELECT lang, {', '.join(f'min(step) FILTER (below >= {x} * every) AS q{k}' for k, x in enumerate(parts))} FROM ({steps}) GROUP BY lang)"

    chars = ", ".join(f"CAST(sum(hc[{i}]) AS DOUBLE)" for i in range(1, 6))
    half = "list_sum({0}) < 2 * {1}"
    return rf"""
WITH a AS MATERIALIZED (SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS words FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS seq FROM (SELECT *, unnest(generate_series(1, len(words) - 7)) AS i FROM a)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, seq) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS j FROM twice) GROUP BY doc_id),
b AS MATERIALIZED (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS rows_, [length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')), length(t) - length(regexp_replace(t, '[0-9]+', '', 'g')),
    length(t) - length(regexp_replace(t, '[#*$%&|<>!?~^_=+@/\\{{}}\[\]]+', '', 'g')), length(t) - length(regexp_replace(t, '[aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüý]+', '', 'g'))] AS h1 FROM a),
c AS MATERIALIZED (SELECT doc_id, lang, CAST(len(words) AS BIGINT) AS n_words, CAST(length(coalesce(array_to_string(words, ''), '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(rows_) - len(list_distinct(rows_)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, h1, strlen(coalesce(array_to_string(words, ''), '')) - length(coalesce(array_to_string(words, ''), '')) AS beyond FROM b LEFT JOIN rep USING (doc_id)),
d AS MATERIALIZED (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, list_transform(list_append(h1, greatest(word_chars - list_sum(h1), 0)), lambda x: CAST(x AS DOUBLE)) AS hc FROM c),
tok AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(t), '[^\x20\x09-\x0D.,;:!?"()\[\]{{}}<>|#*$%&+=~^_/\\@]+') AS ws FROM a),
wc AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM tok) WHERE length(w) <= 6 GROUP BY ALL),
size AS MATERIALIZED (SELECT doc_id, CAST(len(ws) AS DOUBLE) AS words FROM tok WHERE len(ws) > 0),
named AS MATERIALIZED (SELECT * FROM d WHERE lang IS NOT NULL AND NOT base_failed),
first AS MATERIALIZED (SELECT lang, [{chars}] AS rc FROM named GROUP BY lang HAVING count(*) >= 0.001 * (SELECT count(*) FROM named)),
placed AS MATERIALIZED (SELECT named.*, {distance('hc', 'rc')} AS own FROM named JOIN first USING (lang)),
{quantiles('cut', 'placed', 'own', 0.5)},
core AS MATERIALIZED (SELECT placed.* FROM placed JOIN cut USING (lang) WHERE floor(1000 * own) <= q0),
cw AS MATERIALIZED (SELECT lang, w, sum(n) AS n FROM core JOIN wc USING (doc_id) GROUP BY ALL),
top AS MATERIALIZED (SELECT lang, w, n FROM cw QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) <= 32),
refs AS MATERIALIZED (SELECT lang, rc, {half.format('rc', 'bc')} AS script, common, k, total FROM (SELECT lang, [{chars}] AS rc, sum(beyond) AS bc FROM core GROUP BY lang)
    JOIN (SELECT lang, sum(words) AS total FROM core JOIN size USING (doc_id) GROUP BY lang) USING (lang) JOIN (SELECT lang, sum(n) AS common, count(*) AS k FROM top GROUP BY lang) USING (lang)),
near_c AS (SELECT doc_id, min({distance('hc', 'rc')}) AS dc FROM d JOIN refs ON ({half.format('hc', 'beyond')}) = script GROUP BY doc_id),
met AS (SELECT doc_id, lang, sum(wc.n) AS n, sum(top.n) AS q, sum({term('(wc.n / words)', '(top.n / total)')}) AS t FROM wc JOIN top USING (w) JOIN refs USING (lang) JOIN size USING (doc_id) GROUP BY ALL),
near_w AS (SELECT doc_id, min({{'d': (coalesce(t, 0) + (common - coalesce(q, 0)) / total + {term('((words - coalesce(n, 0)) / words)', '((total - common) / total)')}) / 2 - k / (8 * ln(2) * words), 'lang': lang, 'share': coalesce(n, 0) / words}}) AS v
    FROM (SELECT * FROM size, refs) LEFT JOIN met USING (doc_id, lang) GROUP BY doc_id),
e AS MATERIALIZED (SELECT d.doc_id, n_words, word_chars, base_failed, dc, sqrt(greatest(v.d, 0)) AS dw, v.lang AS lang, v.share AS share FROM d LEFT JOIN near_c USING (doc_id) LEFT JOIN near_w USING (doc_id)),
{quantiles('qc', '(SELECT * FROM e WHERE NOT base_failed AND word_chars >= 200 AND lang IS NOT NULL AND dc IS NOT NULL)', 'dc', 0.25, 0.75)},
{quantiles('qw', '(SELECT * FROM e WHERE NOT base_failed AND n_words >= 80 AND lang IS NOT NULL AND dw IS NOT NULL)', 'dw', 0.25, 0.75)},
f AS (SELECT e.*, greatest(0.2, coalesce((qc.q1 + 1.5 * (qc.q1 - qc.q0)) / 1000, 0)) AS lc, greatest(0.25, coalesce((qw.q1 + 1.5 * (qw.q1 - qw.q0)) / 1000, 0)) AS lw FROM e LEFT JOIN qc USING (lang) LEFT JOIN qw USING (lang))
SELECT d.doc_id, d.n_words, d.word_chars, n_symbols, n_dup_lines, n_repeat_words, d.base_failed,
    NOT d.base_failed AND NOT coalesce(f.word_chars >= 200 AND dc > lc, false) AND NOT coalesce(f.n_words >= 80 AND dw > lw AND (share >= 0.15 OR coalesce(dc > lc / 2, false)), false) AS kept
FROM d JOIN f USING (doc_id)"""


ORACLE_SQL = {"op2_substrings": OP2, "op3_embeddings": OP3, "op4_rules": _op4(), "op8_mixing": OP8, "op12_trie": OP12, "op13_clusters": _op13()}
