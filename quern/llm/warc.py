"""WARC derivatives: metadata and plain-text conversion records from response records.

`derive` turns each response into two linked records: a `metadata` record with the figures of the
page, and a `conversion` record with its plain text. Both name the response in WARC-Refers-To and
keep its target, date, HTTP status, content type, whole block of HTTP headers and payload digest; each has an own record id,
derived from the response's, and a digest of its block. All of it is one projection over the
responses: no shuffle, and no state beyond a row.

Defined results: a null payload counts as an empty one; a null header or target stays out of the
record's header; a response with a null id gets ids derived from the empty string; repeated
responses each give their two records, with equal ids; an empty table gives an empty result;
extra columns are dropped but for those that `keep` names, which may have any name but an output column's: such a one is replaced by it. Character references by number or by a name of HTML 4 are decoded, also in titles and links; references to no
character become U+FFFD, and unknown names stay as they are.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quern.llm.common import free_names, md5_int

HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script[^>]*>|<style\b.*?</style[^>]*>|<noscript\b.*?</noscript[^>]*>"
BLOCKS = r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|article|section|nav|header|footer|aside|main|title|head|body|html|blockquote|pre|form|figure)\b[^>]*>"
TAGS = r"</?[A-Za-z!?][^>]*>"
#: What follows the ampersand of a character reference.
REFERENCE = r"(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
NAMES = {name: chr(point) for name, point in name2codepoint.items()} | {"apos": "'"}
BLANKS = r"[ \t\x0B\f\r\x{00A0}]+"
LINK = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def decoded(text: Column) -> Column:
    """The text with its character references decoded, each once; &amp; comes last."""
    rare = rf"&(?!amp;)(?={REFERENCE})"
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])

    def part(x: Column) -> Column:
        name = F.substring_index(x, ";", 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2)))
        point = number.cast("int")
        valid = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
        character = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise("\ufffd")
        # A reference to an ampersand stands as &amp; until the end.
        found = F.when(name.startswith("#"), F.when(point == 38, "&amp;").otherwise(character)).otherwise(F.try_element_at(names, name))
        return F.coalesce(F.concat(found, F.substr(x, F.length(name) + 2)), F.concat(F.lit("&"), x))

    parts = F.transform(F.split(text, rare), lambda x, i: F.when(i == 0, x).otherwise(part(x)))
    return F.replace(F.array_join(parts, ""), F.lit("&amp;"), F.lit("&"))


def plain_text(html: Column) -> Column:
    """The text of a page: hidden elements dropped, block elements on lines of their own, other tags dropped."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    out = F.regexp_replace(F.regexp_replace(out, BLOCKS, "\n"), TAGS, "")
    out = F.regexp_replace(decoded(out), BLANKS, " ")
    return F.btrim(F.regexp_replace(out, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def title(html: Column) -> Column:
    return F.trim(F.regexp_replace(decoded(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title", 1)), r"[ \t\x0B\f\r\n\x{00A0}]+", " "))


def links(html: Column) -> Column:
    """The targets of a page's links, in order."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINK), F.lit(1))
    bare = lambda x: F.when(x.startswith('"') | x.startswith("'"), F.substr(x, F.lit(2), F.length(x) - 2)).otherwise(x)
    return F.transform(found, lambda x: F.when(x.contains("&"), decoded(bare(x))).otherwise(bare(x)))


def urn(value: Column) -> Column:
    """A record id: the MD5 of a string in the form of a UUID."""
    h = F.md5(value)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def digest(value: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(value))


SERVERS = ("nginx", "Apache/2.4.57 (Debian)", "cloudflare")


def responses_from_pages(pages: DataFrame) -> DataFrame:
    """Response records (record_id, target_uri, warc_date, http_headers, payload, payload_digest) for pages (page_id, url, html).

    The pages have no headers, so status, server, spelling and order of these come from digests of the page's id.
    """
    body = F.coalesce("html", F.lit(""))
    mark = md5_int(F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    status = F.when(mark % 23 == 0, "404 Not Found").when(mark % 29 == 0, "503 Service Unavailable").otherwise("200 OK")
    server = F.element_at(F.array(*map(F.lit, SERVERS)), (mark % 3 + 1).cast("int"))
    kind = F.when(mark % 2 == 0, "Content-Type: text/html; charset=utf-8").otherwise("content-type:text/html")
    lines = F.array(F.concat(F.lit("Server: "), server), kind, F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")), F.concat(F.lit("X-Cache: "), F.when(mark % 5 == 0, "HIT").otherwise("MISS")))
    head = F.concat(F.lit("HTTP/1.1 "), status, F.lit("\r\n"), F.array_join(F.when(mark % 7 == 0, F.reverse(lines)).otherwise(lines), "\r\n"), F.lit("\r\n\r\n"))
    # Ids of other types than numbers are dated by their digests.
    number = F.coalesce("page_id", F.lit(0)) if isinstance(pages.schema["page_id"].dataType, IntegralType) else mark
    day = F.date_add(F.lit("2024-01-01").cast("date"), (number % 366).cast("int"))
    return pages.select(
        urn(F.concat_ws(" ", F.col("page_id").cast("string"), "url")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.concat(day.cast("string"), F.lit("T00:00:00Z")).alias("warc_date"),
        head.alias("http_headers"),
        F.col("html").alias("payload"),
        digest(body).alias("payload_digest"),
        "page_id",
    )


#: The columns of a derived record.
OUTPUT = (
    "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "source_status", "source_content_type", "source_http_headers", "source_payload_digest", "content_type",
    "content_length", "block_digest", "content",
)


def derive(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two rows per response; `keep` names columns of the responses to pass on."""
    keep = [c for c in keep if c not in OUTPUT]
    # Kept columns go by generated names until the end, so that they clash with no step's own.
    held = dict(zip(free_names(responses, *(f"keep{k}" for k in range(len(keep)))), keep, strict=True))
    quoted = {c: "`" + c.replace("`", "``") + "`" for c in keep}
    kept = [F.col(quoted[c]).alias(name) for name, c in held.items()]
    source = F.coalesce("record_id", F.lit(""))
    status = F.regexp_extract(F.coalesce("http_headers", F.lit("")), r"^HTTP/[0-9.]+ ([0-9]{3})", 1)
    kind = F.trim(F.regexp_extract(F.coalesce("http_headers", F.lit("")), r"(?i)\r\nContent-Type:([^\r\n]*)", 1))
    # The text and the links are used several times, so they get a projection of their own.
    read = responses.select(
        *kept, "record_id", "target_uri", "warc_date", "payload_digest", F.col("http_headers").alias("source_http_headers"), source.alias("_source"),
        status.alias("source_status"), kind.alias("source_content_type"),
        plain_text(F.col("payload")).alias("_text"), title(F.col("payload")).alias("_title"), links(F.col("payload")).alias("_links"),
    )
    fields = F.concat(
        F.lit("title: "), F.col("_title"), F.lit("\r\nhttp-status: "), F.col("source_status"), F.lit("\r\ncontent-type: "), F.col("source_content_type"),
        F.lit("\r\ntext-length: "), F.length("_text").cast("string"), F.lit("\r\noutlinks: "), F.size("_links").cast("string"),
        F.concat_ws("", F.transform("_links", lambda x: F.concat(F.lit("\r\noutlink: "), x))), F.lit("\r\n"),
    )

    def record(name: str, content_type: str, content: Column) -> Column:
        return F.struct(
            F.lit(name).alias("warc_type"), urn(F.concat(F.col("_source"), F.lit(" " + name))).alias("derived_id"),
            F.lit(content_type).alias("content_type"), content.alias("content"),
        )

    both = read.select(
        *held, "record_id", "target_uri", "warc_date", "payload_digest", "source_status", "source_content_type", "source_http_headers",
        F.inline(F.array(record("metadata", "application/warc-fields", fields), record("conversion", "text/plain", F.col("_text")))),
    )
    return both.select(
        *(F.col(name).alias(c) for name, c in held.items()), "warc_type", F.col("derived_id").alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "warc_date",
        "source_status", "source_content_type", "source_http_headers", F.col("payload_digest").alias("source_payload_digest"), "content_type",
        F.octet_length("content").cast("long").alias("content_length"), digest(F.col("content")).alias("block_digest"), "content",
    )


#: Header lines of a record and the columns they come from.
HEADER = (
    ("WARC-Type", "warc_type"),
    ("WARC-Record-ID", "record_id"),
    ("WARC-Refers-To", "refers_to"),
    ("WARC-Target-URI", "target_uri"),
    ("WARC-Date", "warc_date"),
    ("WARC-Source-Status", "source_status"),
    ("WARC-Source-Content-Type", "source_content_type"),
    ("WARC-Source-HTTP-Headers", "source_http_headers"),
    ("WARC-Payload-Digest", "source_payload_digest"),
    ("WARC-Block-Digest", "block_digest"),
    ("Content-Type", "content_type"),
    ("Content-Length", "content_length"),
)


def serialize(records: DataFrame) -> DataFrame:
    """One column, `value`: each record as WARC/1.1 text, the source's headers folded. Written with line separator "\\r\\n\\r\\n", part files are WARC files."""
    head = [F.concat(F.lit(f"{name}: "), F.replace(F.col(column).cast("string"), F.lit("\r\n"), F.lit("\r\n\t")), F.lit("\r\n")) for name, column in HEADER]
    return records.select(F.concat(F.lit("WARC/1.1\r\n"), F.concat_ws("", *head), F.lit("\r\n"), F.col("content")).alias("value"))


def parse(values: DataFrame) -> DataFrame:
    """The records of `serialize`, read back."""
    head = F.substring_index("value", "\r\n\r\n", 1)
    fields = [F.nullif(F.replace(F.regexp_extract(head, rf"\r\n{name}: ((?:[^\r\n]|\r\n\t)*)", 1), F.lit("\r\n\t"), F.lit("\r\n")), F.lit("")).alias(column) for name, column in HEADER]
    return values.select(*fields, F.expr("substring(value, length(substring_index(value, '\r\n\r\n', 1)) + 5)").alias("content")).withColumn("content_length", F.col("content_length").cast("long"))
