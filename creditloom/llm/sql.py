"""DuckDB forms of the queries that SQL can state."""

OP6 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark),
lengths AS (SELECT DISTINCT least(13, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, w[i : i + least(13, len(w)) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, k, w[i : i + k - 1] AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lengths WHERE len(w) >= k)),
m AS (SELECT doc_id, i, dw.k AS k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM m))
  GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
       CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AND 20 * coalesce(hit.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS x,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
spans AS (
  SELECT doc_id, k, i, sha256(array_to_string(w[i : i + k - 1], ' ')) AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM d, (VALUES (3), (10), (101)) AS ks(k) WHERE len(w) >= k)),
again AS (SELECT doc_id, k, i FROM spans QUALIFY count(*) OVER (PARTITION BY doc_id, k, win) > 1),
covered AS (
  SELECT doc_id, k, count(DISTINCT p) AS n
  FROM (SELECT doc_id, k, unnest(range(i, i + k)) AS p FROM again) GROUP BY doc_id, k),
wide AS (
  SELECT doc_id, max(n) FILTER (k = 3) AS n3, max(n) FILTER (k = 10) AS n10, max(n) FILTER (k = 101) AS n101
  FROM covered GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n3, 0) AS BIGINT) AS n_repeat_words,
         coalesce(n10, 0) AS n10, coalesce(n101, 0) AS n101
  FROM d LEFT JOIN wide ON d.doc_id = wide.doc_id LEFT JOIN lines ON d.doc_id = lines.doc_id),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n10 <= 0.3 * n_words AND n101 = 0 AS kept
FROM judged
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS draw,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1 AS BIGINT) AS rk
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS bound,
         CASE rk % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0.0 ELSE 0.5 END AS tilt FROM s),
o AS (
  SELECT *, row_number() OVER b AS turn,
         coalesce(sum(bound) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_words,
         sum(weight) OVER () - coalesce(sum(weight) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_weight,
         sum(source_size) OVER () AS words
  FROM w WINDOW b AS (ORDER BY CAST(bound AS DOUBLE) / weight, rk)),
l AS (SELECT *, CAST(words - full_words AS DOUBLE) / CAST(open_weight AS DOUBLE) AS level FROM o),
f AS (SELECT arg_min(level, turn) AS level FROM l WHERE level * weight <= bound),
t AS (SELECT l.*, least(CAST(bound AS DOUBLE), f.level * weight) AS target FROM l, f),
p AS (
  SELECT rk, draw, doc_id, size, source_size, target, CAST(tilt AS DOUBLE) AS tilt,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, target - passes * source_size AS rest, size * 16 > target - passes * source_size AS big FROM p),
q1 AS (
  SELECT *, coalesce(sum(size) OVER o, 0) AS ahead,
         coalesce(sum(CASE WHEN big THEN size ELSE 0 END) OVER o, 0) AS ahead1,
         coalesce(sum(CASE WHEN big THEN 0 ELSE size END) OVER o, 0) AS ahead2
  FROM q WINDOW o AS (PARTITION BY rk ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q2 AS (SELECT *, passes < 3 AND big AND ahead1 + size <= rest AS fits FROM q1),
q3 AS (
  SELECT *, max(CASE WHEN fits THEN ahead1 + size ELSE 0 END) OVER (PARTITION BY rk) AS filled1 FROM q2),
q4 AS (
  SELECT *, rest - filled1 AS gap1, passes < 3 AND NOT big AND ahead2 + size <= rest - filled1 AS refits FROM q3),
q5 AS (
  SELECT *, max(CASE WHEN refits THEN ahead2 + size ELSE 0 END) OVER (PARTITION BY rk) AS filled2,
         NOT fits AND NOT refits AND passes < 3 AND size > 0 AS unused FROM q4),
q6 AS (
  SELECT *, gap1 - filled2 AS gap2,
         coalesce(sum(CASE WHEN unused THEN size ELSE 0 END) OVER (PARTITION BY rk ORDER BY size, draw, doc_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead3 FROM q5),
q7 AS (
  SELECT *, unused AND 2 * (gap2 - ahead3) > size AS closes,
         filled1 + filled2 + min(CASE WHEN unused THEN ahead3 END) OVER (PARTITION BY rk, size) AS place3 FROM q6),
c AS (
  SELECT *, CAST(passes + CASE WHEN fits OR refits OR closes THEN 1 ELSE 0 END AS BIGINT) AS copies,
         CASE WHEN target > 0 THEN least(CASE WHEN passes = 0 AND closes THEN place3
                                              WHEN passes = 0 AND refits THEN filled1 + ahead2
                                              WHEN passes = 0 AND fits THEN ahead1
                                              ELSE ahead END / target, 1.0) ELSE 0 END AS share
  FROM q7)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies,
       CASE WHEN copies > 0 THEN
         round(CASE WHEN (1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 2 * (2 * tilt) * share) > 0
                    THEN 2 * share / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 2 * (2 * tilt) * share)) ELSE 0 END, 6)
       END AS first_position
FROM c
"""

OP5 = r"""
WITH u AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, 'allow') AS verdict
FROM (SELECT *, row_number() OVER () AS n FROM p)
LEFT JOIN (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow'))
     AS r(rule, rule_host, rule_path, verdict)
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(r.rule) DESC NULLS LAST) = 1
"""

OP7 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '"', '&quot;'))
          + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;')) + 22 AS chars FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss,
         sum(chars) AS chars
  FROM e GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256,
       CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM g
"""


def _op13(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Rounds of assignment (a0, a1, ...) and new entries (b0, b1, ...), one after the other."""
    steps = [
        f"""
v AS (
  SELECT vec_id, label,
         list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, part, c[part * len(c) // {parts} + 1 : (part + 1) * len(c) // {parts}] AS x
  FROM v, (SELECT unnest(range({parts})) AS part)),
b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c
  FROM p QUALIFY entry < {entries})"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""
a{i} AS MATERIALIZED (
  SELECT part, vec_id, any_value(x) AS x, arg_min(entry, away * {entries} + entry) AS entry,
         min(away) AS away
  FROM (SELECT p.part, vec_id, x, entry,
               list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS away
        FROM p JOIN b{i} ON p.part = b{i}.part)
  GROUP BY part, vec_id)"""
        )
        if i < rounds:
            steps.append(
                f"""
b{i + 1} AS MATERIALIZED (
  SELECT b{i}.part, b{i}.entry, coalesce(m.c, b{i}.c) AS c
  FROM b{i} LEFT JOIN (
    SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY k) AS c
    FROM (SELECT part, entry, k, CAST(sum(z) AS BIGINT) AS s, count(*) AS n
          FROM (SELECT part, entry, unnest(x) AS z, unnest(range(len(x))) AS k FROM a{i})
          GROUP BY part, entry, k)
    GROUP BY part, entry) m
  ON b{i}.part = m.part AND b{i}.entry = m.entry)"""
            )
    steps.append(
        f"""
digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256
  FROM b{rounds}),
coded AS (
  SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code,
         CAST(sum(away) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id)"""
    )
    return (
        "WITH "
        + ",".join(steps)
        + """
SELECT vec_id, code, error,
       CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN v USING (vec_id), digest
"""
    )


OP13 = _op13()

OP12 = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (  -- crc32 of the decimal digits, bit by bit
  SELECT c, xor(list_reduce(
           list_concat([4294967295::UBIGINT],
                       list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: ascii(s)::UBIGINT)),
           lambda crc, byte: list_reduce(
             list_concat([xor(crc, byte)], list_transform(range(8), lambda z: 0::UBIGINT)),
             lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM t)),
r AS (
  SELECT c, 0 AS own, i, role, text FROM c JOIN t ON t.conv_id = c - c % 100 AND i <= h
  UNION ALL
  SELECT c, 1 AS own, i, role, text FROM c JOIN t ON t.conv_id = c AND i > h),
x AS (
  SELECT c.c AS c, coalesce(s.x, []) AS x FROM c LEFT JOIN (
    SELECT c, list({'role': role, 'text': text} ORDER BY own, i) AS x FROM r GROUP BY c) s ON c.c = s.c),
n AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (whole), '') AS ends,
         CASE WHEN d > 0 THEN length(p[d].text) ELSE 0 END AS chars
  FROM (SELECT c, d, x[1 : d] AS p, d = len(x) AS whole
        FROM (SELECT c, x, unnest(range(len(x) + 1)) AS d FROM x))
  GROUP BY p, d),
k AS (SELECT p[1 : d - 1] AS p, d - 1 AS d, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k ON n.d = k.d AND n.p = k.p),
u AS (
  SELECT p[1 : a] AS p, a AS d, count(*) FILTER (n_children = 0) AS n_leaves,
         sum((n_convs - 1) * chars) AS saved
  FROM (SELECT m.*, unnest(range(d + 1)) AS a FROM m) GROUP BY ALL)
SELECT m.conv_id, m.d AS depth, above.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN u ON m.d = u.d AND m.p = u.p
LEFT JOIN n above ON above.d = m.d - 1 AND above.p = m.p[1 : m.d - 1]
"""

OP11 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS MATERIALIZED (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS size FROM v),
e AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.93),
r AS (
  SELECT a AS vec_id, a AS low FROM e
  UNION
  SELECT e.b, r.low FROM r JOIN e ON r.vec_id = e.a WHERE r.low < e.b),
c AS (SELECT vec_id, min(low) AS low FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT w.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.low, w.vec_id) AS component_id,
       coalesce(c.low, w.vec_id) = w.vec_id AS kept
FROM embeddings w LEFT JOIN c ON w.vec_id = c.vec_id LEFT JOIN n ON w.vec_id = n.vec_id
"""

OP9 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i : i + 19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
k AS (
  SELECT x.doc_id AS doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x
  LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p
  WHERE gone.p IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
