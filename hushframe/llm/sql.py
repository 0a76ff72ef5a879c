"""DuckDB SQL that states the results of the queries that SQL can express."""

from __future__ import annotations

#: (host, path, action)
SITE_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: (name, action, regex over host + path, whole tokens of every match; a|b: one of them)
PATTERN_RULES = [
    ("pills", "block", r"^(?:[^/]*[.-])?cheap-pills[.-]", ("cheap", "pills")),
    ("spam farm", "block", r"^(?:[^/]*[.-])?spam-farm[.-]", ("spam", "farm")),
    ("casino", "block", r"^[^/]*(?:^|[.-])casino[.-]", ("casino",)),
    ("adult", "block", r"(?:^|[./-])(?:free-)?xxx(?:[./-]|$)", ("xxx",)),
    ("tracker", "block", r"^(?:ads|adserver)\.", ("ads|adserver",)),
    ("link shop", "block", r"/buy-backlinks(?:/|$)", ("buy", "backlinks")),
    ("payday", "block", r"(?:^|[.-])payday-loans?[.-]", ("payday",)),
    ("torrent", "block", r"^[^/]*(?:^|[.-])torrent[.-]", ("torrent",)),
]


def _sites() -> str:
    rows = ", ".join(f"('{h}{p}', '{h}', '{p}', '{a}')" for h, p, a in SITE_RULES)
    return f"(VALUES {rows}) r(rule, rhost, rpath, action)"


_BLOCKED = " OR ".join(f"regexp_matches(host || path, '{r}')" for _, _, r, _ in PATTERN_RULES)
_FIRST = "CASE " + " ".join(
    f"WHEN regexp_matches(host || path, '{r}') THEN '{n}'" for n, _, r, _ in sorted(PATTERN_RULES, reverse=True)
) + " END"

OP3 = rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
b AS (
  SELECT page_id, max({{'n': length(rule), 'rule': rule, 'action': action}}) AS best
  FROM u JOIN {_sites()} ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id)
SELECT u.page_id, host, path, best.rule AS rule,
  coalesce(best.action, CASE WHEN {_BLOCKED} THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN best IS NULL THEN {_FIRST} END AS pattern
FROM u LEFT JOIN b USING (page_id)
"""

_CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
OP4 = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(text, '{_CONTROL}', '\1\\\2\3', 'g')) AS body,
    length(regexp_replace(role, '{_CONTROL}', '\1\\\2\3', 'g')) AS head FROM c),
p AS (
  SELECT *, row_number() OVER w AS pos, CAST(ceil(body / 4.0) AS BIGINT) + 4 AS cost, head + body + 15 AS said FROM e
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY conv_id ORDER BY pos) AS BIGINT) - cost AS start FROM p),
k AS (SELECT *, 2 * (start // 1024) + CAST((start + cost - 1) // 1024 > start // 1024 AS BIGINT) AS span FROM s),
h AS (
  SELECT *, coalesce(sum(said + 9) OVER r, 0) AS recent, min(pos) OVER r AS first_recent,
    min(CASE WHEN role = 'system' THEN pos END) OVER (PARTITION BY conv_id) AS sys FROM k
  WINDOW r AS (PARTITION BY conv_id ORDER BY start RANGE BETWEEN 256 PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT h.*, row_number() OVER (PARTITION BY h.conv_id, h.span ORDER BY h.pos) AS nth, g.said AS sys_said
  FROM h LEFT JOIN h g ON g.conv_id = h.conv_id AND g.pos = h.sys),
n AS (
  SELECT conv_id, CAST(sum(said + 8 + CASE WHEN nth = 1 THEN recent
    + CASE WHEN sys < pos AND (first_recent IS NULL OR first_recent > sys) THEN sys_said + 9 ELSE 0 END ELSE 0 END) AS BIGINT) AS formatted_chars
  FROM f GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '')) AS loss_sha256, formatted_chars
FROM f JOIN n USING (conv_id) GROUP BY conv_id, formatted_chars
"""

OP6 = r"""
WITH l AS (
  SELECT doc_id, i, list_extract(ls, i) AS body FROM (
    SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
w AS (
  SELECT doc_id, i, body, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS words,
    row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM l WHERE regexp_matches(body, '[^\x20\x09-\x0D]')),
s AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY place) AS upto FROM w),
f AS (
  SELECT a.doc_id, a.place AS start, min(b.place) AS stop FROM s a JOIN s b
  ON a.doc_id = b.doc_id AND b.place BETWEEN a.place AND a.place + 9 AND b.upto - a.upto + a.words >= 10 GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.place), b.place FROM s a JOIN s b
  ON a.doc_id = b.doc_id AND b.place BETWEEN a.place AND a.place + 9 AND b.upto - a.upto + a.words >= 10 GROUP BY b.doc_id, b.place),
r AS (
  SELECT f.doc_id, start, stop, string_agg(body, chr(10) ORDER BY place) AS run FROM f JOIN s ON f.doc_id = s.doc_id AND place BETWEEN start AND stop
  GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, start) AS nth FROM r),
g AS (SELECT DISTINCT d.doc_id, s.i FROM d JOIN s ON d.doc_id = s.doc_id AND s.place BETWEEN d.start AND d.stop WHERE nth > 1),
k AS (
  SELECT l.doc_id, coalesce(string_agg(body, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text, count(g.i) AS lines_removed
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT doc_id, CASE WHEN documents.text IS NOT NULL THEN coalesce(k.text, '') END AS text, CAST(coalesce(lines_removed, 0) AS INTEGER) AS lines_removed
FROM documents LEFT JOIN k USING (doc_id)
"""

OP8 = r"""
WITH q AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 4.0 WHEN 0 THEN 1.0 ELSE 2.0 END) AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    -ln((CAST('0x' || md5('8:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:13] AS BIGINT) + 0.5) / 4503599627370496.0)
      / coalesce(CAST(quality AS DOUBLE), 2.0) AS key
  FROM documents LEFT JOIN q USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source) AS nth FROM w),
v AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
t AS (
  SELECT source, source_size, least(weight * (SELECT level FROM v WHERE weight * level <= cap ORDER BY nth LIMIT 1), cap) AS target
  FROM v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 3 END AS epochs FROM t),
p AS (
  SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, epochs + CAST(rest > 0 AND before + size / 2.0 < rest AS BIGINT) AS copies,
  size * (epochs + CAST(rest > 0 AND before + size / 2.0 < rest AS BIGINT)) AS taken
FROM p
"""

OP9 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP10 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM g
"""


OP11 = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, row_number() OVER () AS r
  FROM documents),
i AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
p AS (SELECT r, i FROM i QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
n AS (SELECT r, count(DISTINCT i + d) AS n_repeat_words FROM p, range(3) t(d) GROUP BY r),
m AS (
  SELECT doc_id, text, ws, ls, len(ws) AS n_words, CAST(length(list_aggregate(ws, 'string_agg', '')) AS BIGINT) AS chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN n USING (r)),
b AS (SELECT *, coalesce(chars, 0) AS word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
    OR 2 * n_dup_lines > len(ls) OR 10 * len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) < 7 * n_words
    OR 2 * len(regexp_extract_all(text, '\p{Lu}')) > len(regexp_extract_all(text, '\p{L}'))
    OR 10 * len(regexp_extract_all(text, '(?:\.\.\.|…)[ \t]*(?:\n|$)')) > 3 * len(string_split(text, chr(10)))
    OR regexp_matches(text, '(?i)lorem ipsum dolor')) AS kept
FROM b
"""

OP12 = r"""
WITH w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, 5) t(m) WHERE len(ws) >= m),
f AS MATERIALIZED (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2),
k AS (
  SELECT lang, phrase, a, k, array_to_string(ws[:k], ' ') AS lft, array_to_string(ws[k + 1:], ' ') AS rgt
  FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM c)),
s AS (
  SELECT k.lang, k.phrase, a, k, x.n AS l, y.n AS r, 2000000 * CAST(a AS HUGEINT) // (x.n + y.n) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = lft JOIN f y ON y.lang = k.lang AND y.phrase = rgt),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, array_to_string(ws[j:j + m - 1], ' ') AS phrase, max(a) AS longer FROM (
    SELECT *, unnest(range(1, len(ws) - m + 2)) AS j FROM (SELECT *, unnest(range(2, len(ws))) AS m FROM c WHERE len(ws) > 2)) GROUP BY ALL),
r AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN i ON b.lang = i.lang AND b.phrase = i.phrase WHERE longer IS NULL OR 100 * longer < 80 * a),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""


def _codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    assigned = """a{0} AS MATERIALIZED (
  SELECT id, part, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(p.x, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), e := entry)) AS best
  FROM p JOIN b{0} b USING (part) GROUP BY id, part)"""
    moved = """m{0} AS (
  SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS y FROM (
    SELECT a.part, best.e AS entry, j, CAST(sum(x[j]) AS HUGEINT) AS s, count(*) AS n
    FROM a{0} a JOIN (SELECT id, part, x, unnest(range(1, len(x) + 1)) AS j FROM p) q USING (id, part) GROUP BY ALL) GROUP BY part, entry),
b{1} AS MATERIALIZED (SELECT part, entry, coalesce(m{0}.y, b{0}.y) AS y FROM b{0} LEFT JOIN m{0} USING (part, entry))"""
    steps = [x for r in range(rounds) for x in (assigned.format(r), moved.format(r, r + 1))] + [assigned.format(rounds)]
    listed = ",\n".join(steps)
    return rf"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS id, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT id, i AS part, v[i * len(v) // {parts} + 1:(i + 1) * len(v) // {parts}] AS x FROM v, range({parts}) r(i)),
b0 AS MATERIALIZED (SELECT part, id - 1 AS entry, x AS y FROM p WHERE id <= {entries}),
{listed},
c AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
e AS (
  SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM a{rounds} JOIN v USING (id) GROUP BY id, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e, c
"""


SQL = {
    "op3_url_filters": OP3, "op4_chat_format": OP4, "op6_line_dedup": OP6, "op8_mix": OP8, "op9_top_k": OP9,
    "op10_exact_dedup": OP10, "op11_quality_rules": OP11, "op12_collocations": OP12, "op13_vector_codes": _codes(),
}
