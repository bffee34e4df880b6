"""DuckDB SQL for the training-data queries that SQL can express, over the driver's views."""

W = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{W}') AS w FROM documents
), win AS (
  SELECT rid, i, list_slice(w, i, i + 4) AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid
), lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{W}') GROUP BY rid
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
    len(list_filter(list_transform(w, lambda x: regexp_extract(lower(x), '^([^.,;:!?#*$%&|<>]*)', 1)), lambda x: x IN ({{stop}})))::BIGINT AS n_stop_words
  FROM d LEFT JOIN cov USING (rid) LEFT JOIN lines USING (rid)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
  AND n_words <= 1000000 AND word_chars / greatest(n_words, 1)::DOUBLE BETWEEN 2 AND 14
  AND n_symbols / greatest(n_words, 1)::DOUBLE <= 0.3
  AND (n_stop_words + 0.5::DOUBLE) / greatest(n_words, 1)::DOUBLE >= 0.02::DOUBLE
  AND n_dup_lines / greatest(n_lines, 1)::DOUBLE <= 0.35::DOUBLE AS kept
FROM m
"""

LINES = rf"""
WITH l AS (
  SELECT doc_id, i, n, line, translate(array_to_string(regexp_extract_all(line, '{W}'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS unit
  FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i, len(x) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL))
), m AS (SELECT *, unit <> '' AND row_number() OVER (PARTITION BY unit ORDER BY doc_id NULLS LAST, i) > 1 AS gone FROM l
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.body, '') END AS text, coalesce(c.n, 0) AS n_removed, coalesce(c.chars, 0) AS removed_chars
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(line || CASE WHEN i < n THEN chr(10) ELSE '' END, '' ORDER BY i) FILTER (NOT gone) AS body, count(*) FILTER (gone) AS n,
    (sum(length(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'))) FILTER (gone))::BIGINT AS chars
  FROM m GROUP BY doc_id
) c USING (doc_id)
"""

_HOST = r"nullif(regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', ''), '')"
_PATH = r"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1)"
_MARK = "('0x' || substr(md5({x}), 1, 8))::BIGINT"

URL_FILTER = f"""
WITH captures AS (
  SELECT page_id, url, {_HOST.format(u="url")} AS host, {_PATH.format(u="url")} AS path,
    DATE '2024-01-01' + ({_MARK.format(x="'fetch' || page_id::VARCHAR")} % 366)::INT AS fetched FROM pages
), hosts AS (SELECT DISTINCT host AS h FROM captures WHERE host IS NOT NULL
), firsts AS (SELECT DISTINCT host || '/' || split_part(path, '/', 2) AS h FROM captures WHERE host IS NOT NULL AND split_part(path, '/', 2) <> ''
), marked AS (SELECT h, 'h' AS t, {_MARK.format(x="h")} AS m FROM hosts UNION ALL SELECT h, 'f', {_MARK.format(x="h")} FROM firsts
), entries AS (
  SELECT 'spam' AS list, 'domain' AS kind, regexp_replace(h, '^(?:www|blog|m)\\.', '') AS pattern, 'add' AS action, DATE '2024-01-01' + (m % 60)::INT AS day
    FROM marked WHERE t = 'h' AND regexp_matches(h, 'spam|pills|casino')
  UNION ALL SELECT 'malware', 'host', h, a, DATE '2024-01-01' + (m % 200 + k)::INT FROM marked, (VALUES ('add', 0), ('remove', 45), ('add', 120)) v(a, k) WHERE t = 'h' AND m % 9 = 0
  UNION ALL SELECT 'paths', 'prefix', h, a, DATE '2024-01-01' + (m % 200 + k)::INT FROM marked, (VALUES ('add', 0), ('remove', 90)) v(a, k) WHERE t = 'f' AND m % 5 = 0
  UNION ALL SELECT 'allow', 'host', h, 'add', DATE '2024-01-01' + (m % 200 + 60)::INT FROM marked WHERE t = 'h' AND m % 27 = 0
), days AS (SELECT list, kind, pattern, day, max(action = 'remove') AS removed FROM entries GROUP BY ALL
), spans AS (SELECT *, lead(day) OVER (PARTITION BY list, kind, pattern ORDER BY day) AS upto FROM days
), live AS (SELECT * FROM spans WHERE NOT removed
), hits AS (
  SELECT c.page_id, c.url, c.fetched, l.list, l.kind, l.pattern, l.day, CASE l.kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END AS grade
  FROM (SELECT DISTINCT page_id, url, host, path, fetched FROM captures) c JOIN live l ON c.fetched >= l.day AND (l.upto IS NULL OR c.fetched < l.upto)
    AND CASE l.kind WHEN 'host' THEN c.host = l.pattern WHEN 'domain' THEN ends_with('.' || c.host, '.' || l.pattern)
      ELSE starts_with(c.host || '/' || array_to_string(list_filter(string_split(c.path, '/'), lambda x: x <> ''), '/') || '/', l.pattern || '/') END
), best AS (
  SELECT page_id, url, count(*) AS n_active, max({{'grade': grade, 'len': length(pattern), 'allowed': list = 'allow', 'list': list, 'kind': kind, 'pattern': pattern, 'day': day}}) AS b
  FROM hits GROUP BY ALL
)
SELECT page_id, url, c.host, strftime(fetched, '%Y-%m-%d') AS fetched, coalesce(n_active, 0) AS n_active, b.list AS matched_list, b.kind AS matched_kind, b.pattern AS matched_pattern,
  strftime(b.day, '%Y-%m-%d') AS listed_on, coalesce(NOT b.allowed, false) AS blocked
FROM captures c LEFT JOIN best USING (page_id, url)
"""


def _warc() -> str:
    from quern.llm import warc

    q = lambda s: "'" + s.replace("'", "''") + "'"
    names = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in warc.NAMES.items()) + "}"
    ref = "&" + warc.REFERENCE

    def decoded(x: str, k: str) -> str:
        number = f"CASE WHEN {k} SIMILAR TO '#[xX].*' THEN ('0x' || substr({k}, 3))::INT ELSE substr({k}, 2)::INT END"
        character = f"CASE WHEN ({number}) BETWEEN 1 AND 55295 OR ({number}) BETWEEN 57344 AND 1114111 THEN chr(({number})::INT) ELSE chr(65533) END"
        one = f"CASE WHEN {k} LIKE '#%' THEN {character} ELSE coalesce(m[{k}], '&' || {k} || ';') END"
        refs = f"list_transform(regexp_extract_all({x}, {q(ref)}), lambda {k}_: substr({k}_, 2, length({k}_) - 2))"
        return f"array_to_string(list_transform(list_zip(string_split_regex({x}, {q(ref)}), list_transform({refs}, lambda {k}: {one})), lambda {k}z: {k}z[1] || coalesce({k}z[2], '')), '')"

    blank = warc.BLANKS
    text = f"regexp_replace(html, {q(warc.HIDDEN)}, ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, {q(warc.BLOCKS)}, chr(10), 'g'), {q(warc.TAGS)}, '', 'g')"
    title = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)"
    urn = lambda x: "'<urn:uuid:' || " + " || '-' || ".join(f"substr(md5({x}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"
    crlf = "chr(13) || chr(10)"
    server = "[" + ", ".join(q(x) for x in warc.SERVERS) + "]"
    return f"""
WITH names AS (SELECT {names} AS m
), p AS (SELECT page_id, url, coalesce(html, '') AS html, {urn("page_id::VARCHAR || ' ' || url")} AS source, {_MARK.format(x="page_id::VARCHAR")} AS mark, m FROM pages, names
), h AS (
  SELECT *, CASE WHEN mark % 23 = 0 THEN '404 Not Found' WHEN mark % 29 = 0 THEN '503 Service Unavailable' ELSE '200 OK' END AS status,
    ['Server: ' || {server}[mark % 3 + 1], CASE WHEN mark % 2 = 0 THEN 'Content-Type: text/html; charset=utf-8' ELSE 'content-type:text/html' END,
      'Content-Length: ' || strlen(html), 'X-Cache: ' || CASE WHEN mark % 5 = 0 THEN 'HIT' ELSE 'MISS' END] AS lines,
    {text} AS raw, {title} AS head_title, list_transform(regexp_extract_all(html, {q(warc.LINK)}, 1), lambda x: regexp_replace(x, '^["'']|["'']$', '', 'g')) AS raw_links FROM p
), t AS (
  SELECT *, 'HTTP/1.1 ' || status || {crlf} || array_to_string(CASE WHEN mark % 7 = 0 THEN list_reverse(lines) ELSE lines END, {crlf}) || {crlf} || {crlf} AS head,
    CASE WHEN mark % 2 = 0 THEN 'text/html; charset=utf-8' ELSE 'text/html' END AS kind,
    regexp_replace(regexp_replace(regexp_replace({decoded("raw", "b")}, {q(blank)}, ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g') AS body,
    trim(regexp_replace({decoded("head_title", "c")}, {q(blank.replace("[ ", "[ " + chr(92) + "n"))}, ' ', 'g')) AS title,
    list_transform(raw_links, lambda x: {decoded("x", "d")}) AS links FROM h
), r AS (
  SELECT *, 'conversion' AS warc_type, 'text/plain' AS content_type, body AS content FROM t
  UNION ALL SELECT *, 'metadata', 'application/warc-fields', 'title: ' || title || {crlf} || 'http-status: ' || status[1:3] || {crlf} || 'content-type: ' || kind || {crlf}
    || 'text-length: ' || length(body) || {crlf} || 'outlinks: ' || len(links) || array_to_string(list_transform(links, lambda x: {crlf} || 'outlink: ' || x), '') || {crlf} FROM t
)
SELECT page_id, warc_type, {urn("source || ' ' || warc_type")} AS record_id, source AS refers_to, url AS target_uri,
  strftime(DATE '2024-01-01' + (page_id % 366)::INT, '%Y-%m-%d') || 'T00:00:00Z' AS warc_date, status[1:3] AS source_status, kind AS source_content_type, head AS source_http_headers,
  'sha1:' || sha1(html) AS source_payload_digest, content_type, strlen(content)::BIGINT AS content_length, 'sha1:' || sha1(content) AS block_digest, content
FROM r
"""


WARC = _warc()
