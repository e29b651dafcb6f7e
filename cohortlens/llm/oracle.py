"""Check SQL of the queries that SQL can express."""

from __future__ import annotations

_ARCHIVE_PAGES = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), h AS (
  SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p
), g AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS original FROM h
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN original IS NULL OR page_id IS NOT DISTINCT FROM original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM g
"""

_NEAR_DUPLICATES = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM w
), sized AS (
  SELECT doc_id, s, CAST(len(s) AS BIGINT) AS n_shingles FROM sets
), tokens AS (
  SELECT doc_id, n_shingles, unnest(s) AS t FROM sized
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n_shingles) AS na, any_value(b.n_shingles) AS nb, count(*) AS met
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * least(a.n_shingles, b.n_shingles) >= 90 * greatest(a.n_shingles, b.n_shingles)
  GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared WHERE 100 * met >= 90 * (na + nb - met)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM sized UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT doc_id, any_value(n_shingles) AS n_shingles, min(b) AS component_id FROM sized JOIN reach ON a = doc_id GROUP BY doc_id
"""

_GROUP_SPELLINGS = """
WITH RECURSIVE crc AS (
  SELECT [list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(0 AS BIGINT) FOR k IN range(8)]),
                      lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS t
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{00C0}-\\x{00FF}]+')) AS run
  FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY 1, 2
), bytes AS (
  SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM counted
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT) FOR i IN range(length(x) // 2)]),
                                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM bytes, crc
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2
), gaps AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), chain AS (
  SELECT word, word AS root, 0 AS steps FROM forms
  UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f
JOIN (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word) c ON f.word = c.word
"""


def sql() -> dict[str, str]:
    return {"op11_group_spellings": _GROUP_SPELLINGS, "op2_near_duplicates": _NEAR_DUPLICATES, "op8_archive_pages": _ARCHIVE_PAGES}
