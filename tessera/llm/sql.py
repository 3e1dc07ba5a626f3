"""Equivalent SQL of the training-data queries, where SQL can express them."""

from __future__ import annotations

_MIX = r"""
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents),
c AS (
  SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS cls FROM s),
n AS (
  SELECT source, cls, CAST(ceil(count(*) / 4096.0) AS BIGINT) AS buckets, sum(size) AS words FROM c GROUP BY source, cls),
src AS (SELECT source, CAST(sum(words) AS BIGINT) AS source_size FROM n GROUP BY source),
w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight, source_size * 3 AS cap FROM src),
l AS (
  SELECT *,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM w),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * CAST(weight AS DOUBLE)) AS target FROM l),
b AS (
  SELECT c.*, CAST('0x' || substr(digest, 1, 8) AS BIGINT) % buckets AS bucket
  FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source AND c.cls = n.cls),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cls, bucket, digest, doc_id) AS rank FROM b),
p AS (
  SELECT r.*, source_size, target, target / nullif(CAST(source_size AS DOUBLE), 0) AS each,
    CAST(CAST('0x' || substr(md5('43:' || coalesce(r.source, '')), 1, 8) AS BIGINT) % 1048576 AS DOUBLE) / 1048576 AS u
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
  CAST(coalesce(floor(u + each * rank) - floor(u + each * (rank - 1)), 0) AS BIGINT) * size AS taken
FROM p
"""

_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"

_CHAT = rf"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS next
  FROM raw),
f AS (
  SELECT *,
    CASE WHEN role IS DISTINCT FROM before THEN '<|im_start|>' || replace({_ESCAPED.format("role")}, chr(10), '<|nl|>') || chr(10) ELSE '<|im_sep|>' END
    || {_ESCAPED.format("text")}
    || CASE WHEN role IS DISTINCT FROM next THEN '<|im_end|>' || chr(10) ELSE '' END AS piece
  FROM o)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 90 * (x.n + y.n - inter)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""

_QUALITY = r"""
WITH d AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS whole FROM documents),
w AS (SELECT rid, regexp_extract_all(whole, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT rid, gram FROM g GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g JOIN r USING (rid, gram)) GROUP BY rid),
l AS (
  SELECT rid, source, whole, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    trim(regexp_replace(regexp_replace(lower(line), '\p{N}', '0', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm
  FROM (SELECT rid, source, whole, unnest(string_split(whole, chr(10))) AS line FROM d)),
x AS (SELECT * FROM l WHERE words > 0),
h AS (SELECT source, count(DISTINCT whole) AS docs FROM d GROUP BY source),
bad AS (
  SELECT source, norm FROM (SELECT source, norm, count(DISTINCT whole) AS n FROM x WHERE words >= 3 GROUP BY ALL) f
  WHERE n > greatest(5, least(0.02 * (SELECT docs FROM h WHERE h.source IS NOT DISTINCT FROM f.source), 100))),
gone AS (SELECT rid, sum(words) AS n FROM x JOIN bad ON x.source IS NOT DISTINCT FROM bad.source AND x.norm = bad.norm GROUP BY rid),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM x GROUP BY rid),
f AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(words, '')), 0) AS BIGINT) AS word_chars,
    CAST(length(whole) - length(translate(whole, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
  FROM d JOIN w USING (rid) LEFT JOIN c USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= 0.3 * n_words AS kept
FROM f
"""

_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS whole FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY whole ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(whole) AS text_sha256
FROM d WINDOW w AS (PARTITION BY whole)
"""

#: CRC-32 of a key written in decimal, bit by bit.
_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0} END"

_MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, {" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))} AS head, {_FIELD.format("text")} AS body
  FROM documents),
c AS (
  SELECT rid, doc_id, source, sha256(head || body) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC32.format("doc_id")} % 5 = 0 THEN sha256(head || translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) ELSE sha256(head || body) END AS f
  FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM c),
t(lvl, source, p, h, n) AS (
  SELECT 0, source, i, leaf, n FROM l
  UNION ALL SELECT lvl + 1, source, p // 16, sha256(string_agg(h, '' ORDER BY p)), (n + 15) // 16 FROM t WHERE n > 1 GROUP BY lvl, source, p // 16, n),
u AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
v(lvl, p, h, n) AS (
  SELECT 0, i, subroot, n FROM u
  UNION ALL SELECT lvl + 1, p // 16, sha256(string_agg(h, '' ORDER BY p)), (n + 15) // 16 FROM v WHERE n > 1 GROUP BY lvl, p // 16, n),
a AS (SELECT lvl, source, p // 16 AS up, string_agg(h, '' ORDER BY p) AS run FROM t WHERE n > 1 GROUP BY ALL),
b AS (SELECT lvl, p // 16 AS up, string_agg(h, '' ORDER BY p) AS run FROM v WHERE n > 1 GROUP BY ALL),
w(rid, source, lvl, p, f, told) AS (
  SELECT rid, source, 0, i, f, '' FROM l
  UNION ALL SELECT w.rid, w.source, w.lvl + 1, w.p // 16, sha256(substr(run, 1, 64 * (p % 16)) || f || substr(run, 64 * (p % 16) + 65)), told || substr(run, 1, 64 * (p % 16)) || substr(run, 64 * (p % 16) + 65)
  FROM w JOIN a ON a.lvl = w.lvl AND a.source IS NOT DISTINCT FROM w.source AND a.up = w.p // 16),
y AS (SELECT rid, source, arg_max(f, lvl) AS f, arg_max(told, lvl) AS told FROM w GROUP BY rid, source),
z(rid, lvl, p, f, told) AS (
  SELECT rid, 0, i, f, told FROM y JOIN u ON u.source IS NOT DISTINCT FROM y.source
  UNION ALL SELECT z.rid, z.lvl + 1, z.p // 16, sha256(substr(run, 1, 64 * (p % 16)) || f || substr(run, 64 * (p % 16) + 65)), told || substr(run, 1, 64 * (p % 16)) || substr(run, 64 * (p % 16) + 65)
  FROM z JOIN b ON b.lvl = z.lvl AND b.up = z.p // 16),
e AS (SELECT rid, arg_max(f, lvl) AS f, arg_max(told, lvl) AS told FROM z GROUP BY rid)
SELECT l.doc_id, l.leaf, u.subroot, r.h AS root, sha256(e.told) AS proof_sha256, e.f AS folded_root, e.f = r.h AS verified
FROM l JOIN e ON e.rid = l.rid JOIN u ON u.source IS NOT DISTINCT FROM l.source, (SELECT h FROM v WHERE n = 1) r
"""

ORACLES: dict[str, str] = {"op1_mix_sources": _MIX, "op3_quality_rules": _QUALITY, "op4_ngram_jaccard": _JACCARD, "op10_chat_format": _CHAT, "op12_exact_dedup": _DEDUP, "op13_merkle_manifest": _MERKLE}
