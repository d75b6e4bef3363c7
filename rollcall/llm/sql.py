"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

#: CRC-32 of a byte list, in DuckDB: the table of 256 remainders, then a fold over the bytes.
_CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"""


def crc32_of(text: str) -> str:
    """An expression for the CRC-32 of ``text``; the query must join ``crc_table``."""
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), "
        "lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)"
    )


OP1 = f"""
WITH RECURSIVE {_CRC_TABLE},
rows_ AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size,
         {crc32_of("coalesce(text, '')")} AS text_crc32, row_number() OVER () AS r
  FROM documents, crc_table),
walk AS (
  SELECT r, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END AS k,
         -1::BIGINT AS b, 0::BIGINT AS j FROM rows_
  UNION ALL
  SELECT r, k2, j, floor((j + 1) * (2147483648.0::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM walk WHERE j < 41)),
placed AS (
  SELECT r, max(b) FILTER (b < 40) AS shard, max(b) AS grown FROM walk GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY (coalesce(doc_id, 0) % 64 + text_crc32) % 64,
         doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown::INT AS grown_shard
FROM rows_ JOIN placed USING (r)
"""

OP12 = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run
  FROM documents),
seen AS (SELECT id, run, count(*) AS c FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, c, {crc32_of("id || ':' || run")} AS h FROM seen, crc_table),
slipped AS (
  SELECT c, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
holes AS (
  SELECT word, n, length(word) AS size, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b USING (size, i, rest) WHERE a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.rest
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.rest),
best AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM near),
found AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words LEFT JOIN (FROM best WHERE place = 1) USING (word)),
chain AS (
  SELECT word, word AS here, 0 AS steps FROM found
  UNION ALL SELECT c.word, f.form, c.steps + 1 FROM chain c JOIN found f ON f.word = c.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM found f JOIN (SELECT word, arg_max(here, steps) AS root FROM chain GROUP BY word) r USING (word)
"""

OP13 = f"""
WITH {_CRC_TABLE},
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
named AS (
  SELECT conv_id, place, dense_rank() OVER (ORDER BY role, text) AS id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words FROM turns),
own AS (SELECT conv_id, list({{'id': id, 'words': words}} ORDER BY place) AS seq FROM named GROUP BY conv_id),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.seq[1:h], []), o.seq[h + 1:]) AS seq
  FROM (SELECT conv_id, seq, {crc32_of("conv_id::VARCHAR")} % 4 AS h FROM own, crc_table) o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
steps AS (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM rebuilt),
members AS (SELECT conv_id, depth, seq[1:depth] AS path, len(seq) = depth AS ends FROM steps),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY path, depth),
children AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
figures AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * n.path[depth].words END AS kept
  FROM nodes n LEFT JOIN children c USING (path)),
below AS (SELECT unnest(range(0, depth + 1)) AS top, path, n_children, kept FROM figures),
sums AS (SELECT path[1:top] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(kept)::BIGINT AS saved_tokens FROM below GROUP BY 1)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM figures f JOIN sums s USING (path) LEFT JOIN nodes p ON f.depth > 0 AND p.depth = f.depth - 1 AND p.path = f.path[1:f.depth - 1]
"""
