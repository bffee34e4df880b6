"""DuckDB SQL for the spelling variants and the Merkle manifest; DuckDB has no CRC-32, so it is spelled out."""

#: CTE with the table of CRC-32, reflected polynomial 0xEDB88320, in one row.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256)) AS i)
)"""


def crc32(bytes_list: str) -> str:
    """The unsigned CRC-32 of a list of bytes, beside crc_table."""
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_list}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def utf8(text: str) -> str:
    """The UTF-8 bytes of a text of characters up to U+00FF."""
    return f"flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 + unicode(x) // 64)::BIGINT, (128 + unicode(x) % 64)::BIGINT] END))"


def _hashed(columns: list[str]) -> str:
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')" for c in columns) + "))"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FIELDS = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR"]

MERKLE = f"""
WITH RECURSIVE {CRC_TABLE}, hashed AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce('=' || source, '') AS tree, {_hashed([*_FIELDS, "text"])} AS leaf,
    CASE WHEN coalesce({crc32(utf8("doc_id::VARCHAR"))} % 5 = 0, false) THEN {_hashed([*_FIELDS, f"translate(text, '{_UPPER}', '{_LOWER}')"])} ELSE {_hashed([*_FIELDS, "text"])} END AS claim
  FROM documents, crc_table
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM hashed
), nodes AS (
  SELECT 0 AS level, tree, i, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT level + 1, tree, i // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY level, tree, i // 16, n
), subroots AS (
  SELECT tree, level AS depth, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, i, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, i // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 16, n
), steps AS (
  SELECT k, level AS step, coalesce(string_agg(digest, '' ORDER BY o) FILTER (WHERE o < own), '') AS l, coalesce(string_agg(digest, '' ORDER BY o) FILTER (WHERE o > own), '') AS r
  FROM (SELECT k, v.level, v.digest, v.i AS o, s.i // (16 ** v.level)::BIGINT AS own FROM leaves s JOIN nodes v ON v.tree = s.tree AND v.n > 1 AND v.i // 16 = s.i // (16 ** (v.level + 1))::BIGINT)
  GROUP BY k, level
  UNION ALL
  SELECT k, depth + level, coalesce(string_agg(digest, '' ORDER BY o) FILTER (WHERE o < own), ''), coalesce(string_agg(digest, '' ORDER BY o) FILTER (WHERE o > own), '')
  FROM (SELECT k, b.depth, v.level, v.digest, v.i AS o, b.i // (16 ** v.level)::BIGINT AS own
    FROM leaves s JOIN subroots b USING (tree) JOIN tops v ON v.n > 1 AND v.i // 16 = b.i // (16 ** (v.level + 1))::BIGINT)
  GROUP BY k, depth, level
), folded AS (
  SELECT k, 0 AS step, claim AS digest FROM leaves
  UNION ALL
  SELECT f.k, f.step + 1, sha256(s.l || f.digest || s.r) FROM folded f JOIN steps s ON s.k = f.k AND s.step = f.step
), proofs AS (SELECT k, sha256(string_agg(l || r, '' ORDER BY step)) AS proof FROM steps GROUP BY k
), ends AS (SELECT k, arg_max(digest, step) AS folded_root FROM folded GROUP BY k
)
SELECT doc_id, leaf, b.digest AS subroot, t.digest AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = t.digest AS verified
FROM leaves s JOIN subroots b USING (tree) JOIN tops t ON t.n = 1 JOIN ends USING (k) LEFT JOIN proofs USING (k)
"""

SPELLING = f"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents
), per_doc AS (SELECT d, run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY d, run
), hashed AS (SELECT run, c, {crc32(utf8("d || ':' || run"))} AS h FROM per_doc, crc_table
), counted AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM hashed
), words AS (SELECT word, sum(c)::BIGINT AS n FROM counted WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), less AS (
  SELECT word, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM words)
), near AS (
  SELECT a.word, b.word AS near FROM less a JOIN less b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word FROM less l JOIN words w ON l.rest = w.word
), best AS (
  SELECT near.word, count(*) AS n_near, min((-w.n, encode(near))) AS b FROM near JOIN words w ON w.word = near.near GROUP BY near.word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 5 * w.n THEN decode(b[2]) END AS form, CASE WHEN -b[1] >= 5 * w.n THEN -b[1] END AS form_n
  FROM words w LEFT JOIN best USING (word)
), up AS (
  SELECT word, word AS root, 0 AS step FROM forms
  UNION ALL SELECT up.word, f.form, step + 1 FROM up JOIN forms f ON f.word = up.root WHERE f.form IS NOT NULL
), roots AS (SELECT word, arg_max(root, step) AS root FROM up GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
