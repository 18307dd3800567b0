"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

from . import mixing, quality

WORD = r"'[^\x20\x09-\x0D]+'"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def quality_rules() -> str:
    ratio = lambda r: f"CASE WHEN {r.under} > 0 THEN CAST({r.over} AS DOUBLE) / {r.under} ELSE 0 END"
    stacked = " UNION ALL ".join(f"SELECT lang, source, '{r.name}' AS rule, {r.slack}e0 AS slack, {ratio(r)} AS v FROM base WHERE NOT base_failed" for r in quality.RULES)
    good = " AND ".join(
        f"coalesce(({ratio(r)}) <= max(CASE WHEN f.rule = '{r.name}' THEN f.high END), true)" + (f" AND coalesce(({ratio(r)}) >= max(CASE WHEN f.rule = '{r.name}' THEN f.low END), true)" if r.low else "") for r in quality.RULES
    )
    quart = lambda keys, n: f"""SELECT {keys}, rule, slack, min(CASE WHEN upto >= 0.25e0 * total THEN val END) AS q1, min(CASE WHEN upto >= 0.5e0 * total THEN val END) AS q2, min(CASE WHEN upto >= 0.75e0 * total THEN val END) AS q3, any_value(total) AS total FROM (
        SELECT *, sum(n) OVER (PARTITION BY {keys}, rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}, rule) AS total, CASE WHEN bucket IS NULL THEN 0e0 ELSE pow({quality.GAMMA}e0, bucket) END AS val
        FROM (SELECT {keys}, rule, slack, b AS bucket, n FROM {n})) GROUP BY {keys}, rule, slack"""  # noqa: E731
    return rf"""WITH words AS MATERIALIZED (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
pos AS MATERIALIZED (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM words),
grams AS (SELECT doc_id, i, a, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c FROM pos WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM grams WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) t(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM words) WHERE regexp_matches(l, {WORD}) GROUP BY doc_id),
base AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
    SELECT d.doc_id, d.lang, d.source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, coalesce(l.n, 0) AS n_lines
    FROM words d LEFT JOIN cover c USING (doc_id) LEFT JOIN lines l USING (doc_id))),
sketch AS MATERIALIZED (SELECT lang, source, rule, slack, CASE WHEN v > 0 THEN CAST(ceil(ln(v) / ln({quality.GAMMA}e0)) AS BIGINT) END AS b0, count(*) AS n FROM ({stacked}) GROUP BY ALL),
fine AS (SELECT lang, source, rule, slack, coalesce(b0, -1099511627776) AS bb, n FROM sketch),
own AS ({quart("lang, source", "(SELECT lang, source, rule, slack, CASE WHEN bb > -1000000 THEN bb END AS b, n FROM fine)").replace("ORDER BY bucket", "ORDER BY bucket NULLS FIRST")}),
wide AS ({quart("lang", "(SELECT lang, rule, slack, CASE WHEN bb > -1000000 THEN bb END AS b, sum(n) AS n FROM fine GROUP BY ALL)").replace("ORDER BY bucket", "ORDER BY bucket NULLS FIRST")}),
lean AS (SELECT o.lang, o.source, o.rule, o.slack, (o.q1 * o.total + w.q1 * 200e0) / (o.total + 200e0) AS q1, (o.q3 * o.total + w.q3 * 200e0) / (o.total + 200e0) AS q3, o.q2 AS m, least(o.q2 - o.q1, o.q3 - o.q2) AS near, w.q2 AS wm, least(w.q2 - w.q1, w.q3 - w.q2) AS wnear FROM own o JOIN wide w ON o.lang IS NOT DISTINCT FROM w.lang AND o.rule = w.rule),
away AS (SELECT *, greatest(slack, 6e0 * (q3 - q1)) AS width, near + greatest(slack, 12e0 * near) AS a, wnear + greatest(slack, 12e0 * wnear) AS wa FROM lean),
f AS MATERIALIZED (SELECT lang, source, rule, greatest(q1 - width, least(m - a, wm - wa)) AS low, least(q3 + width, greatest(m + a, wm + wa)) AS high FROM away)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {good} AS kept, b.lang, b.source
FROM base b LEFT JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
GROUP BY b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, b.lang, b.source"""


def near_duplicates() -> str:
    return rf"""WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), {WORD}) AS w FROM documents),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes k ON k.doc_id = b.doc_id
    WHERE 100 * least(m.n, k.n) >= 80 * greatest(m.n, k.n) GROUP BY a.doc_id, b.doc_id, m.n, k.n HAVING 100 * count(*) >= 80 * (m.n + k.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM words UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept FROM words d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = d.doc_id"""


def mixed() -> str:
    weights = "CASE number % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END"
    inverse = {
        0: "(sqrt(0.25e0 + 2e0 * done) - 0.5e0) / 1e0",
        1: "done",
        2: "CASE WHEN done < 0.625e0 THEN (sqrt(2.25e0 - 2e0 * done) - 1.5e0) / -1e0 ELSE 0.5e0 + (sqrt(1e0 - 2e0 * (done - 0.625e0)) - 1e0) / -1e0 END",
    }
    when = "CASE number % 3 " + " ".join(f"WHEN {k} THEN {x}" for k, x in inverse.items()) + " END"
    return rf"""WITH rows AS MATERIALIZED (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {WORD})) AS BIGINT) AS size, md5('8:' || doc_id) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS number FROM rows GROUP BY source),
w AS (SELECT *, {weights} AS weight, 2e0 * source_size AS cap FROM s),
l AS (SELECT *, (1.5e0 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT *, least(cap, coalesce((SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap) * weight, cap)) AS target FROM l),
d AS (SELECT r.*, g.source_size, g.number, g.target, CAST(sum(size) OVER (PARTITION BY r.source ORDER BY k) - size AS BIGINT) AS before FROM rows r JOIN g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, floor(target) - before)) + greatest(0, least(size, floor(target) - before - source_size)) AS BIGINT) AS taken,
    round_even(CASE WHEN least(size, floor(target) - before) > 0 THEN {when} END * 1e6, 0) / 1e6 + 0e0 AS position FROM (SELECT *, before / target AS done FROM d)"""


def top_k() -> str:
    return """WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)) WHERE rank <= 10"""


def periodic_runs() -> str:
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return rf"""WITH RECURSIVE crc_steps(i, c, k) AS (SELECT i, CAST(i AS BIGINT), 0 FROM range(256) t(i) UNION ALL SELECT i, {step}, k + 1 FROM crc_steps WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8),
base AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS w, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS BIGINT) AS h FROM documents, crc),
planned AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM base),
words AS MATERIALIZED (SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS w FROM planned),
pos AS MATERIALIZED (SELECT doc_id, len(w) AS n, unnest(w) AS x, unnest(range(len(w))) AS i FROM words),
same AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island HAVING count(*) >= 3 * q AND count(*) + q >= 6),
run AS MATERIALIZED (SELECT doc_id, s, l, min(q) AS q FROM stretch GROUP BY doc_id, s, l),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(l AS DECIMAL(18,0)) * 1000000000 // q DESC, s, q) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM pos ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
text_of AS (SELECT doc_id, count(*) AS n, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM run GROUP BY doc_id)
SELECT w.doc_id, coalesce(r.n, 0) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.l AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period, CAST(1000 * b.l // b.q AS BIGINT) AS exponent_milli, sha256(coalesce(r.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM words w LEFT JOIN best b USING (doc_id) LEFT JOIN text_of r USING (doc_id) LEFT JOIN kept k USING (doc_id)"""


def block_norm(rounds: int = 10) -> str:
    """Lloyd's rounds over whole squared distances; doubles hold these exactly."""
    near = "(SELECT vec_id, n, x, k, d FROM (SELECT v.vec_id, v.n, v.x, c.k, list_dot_product(v.x, v.x) + list_dot_product(c.x, c.x) - 2 * list_dot_product(v.x, c.x) AS d FROM v, c{0} c) QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, k) = 1)"
    out = """WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, x FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8)"""
    for r in range(rounds):
        out += f""",
a{r} AS MATERIALIZED {near.format(r)},
m{r} AS (SELECT k, list(floor(s / n) ORDER BY i) AS x FROM (SELECT k, i, sum(y) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY k, i) GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON c.k = m.k)"""
    return out + f""",
last AS MATERIALIZED {near.format(rounds)}
SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(list_transform(c.x, lambda y: CAST(y AS BIGINT)), ',')) AS centroid_sha256 FROM last a JOIN c{rounds} c ON a.k = c.k"""


def oracle_sql() -> dict[str, str]:
    assert mixing.WEIGHTS == (5.0, 2.0, 1.0)
    return {"op12_periodic_runs": periodic_runs(), "op13_blocknorm": block_norm(), "op1_quality_rules": quality_rules(), "op2_minhash": near_duplicates(), "op8_mixing": mixed(), "op10_topk": top_k()}
