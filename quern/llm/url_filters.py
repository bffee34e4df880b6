"""URL filters: a temporal join of captures with dated list entries.

A list's history is a table of dated entries that add or remove a pattern. `intervals` turns it
into validity intervals, one row per time that a pattern was on the list, and `url_filter` judges
every capture by the entries in force on the day it was fetched. Patterns are of three kinds:
"prefix" (a host and the first segments of a path), "host" (one host) and "domain" (a host and all
below it). Of the entries in force, the most specific decides: a longer pattern of a higher kind
beats a shorter one, and an allow list beats a block list on the same pattern.

The verdict depends on the URL and the day alone, so each (url, day) is judged once, however many
captures share it: the distinct pairs are exploded into their patterns, joined with the intervals by
pattern, and the verdicts are joined back. A host with a third of the captures therefore weighs
as many rows as it has different (url, day) pairs; what is left of the skew lies in plain
equi-joins, whose large partitions Spark splits.

Defined results: a null or relative URL has no host and matches nothing; a null fetch date
matches nothing; such captures are kept (blocked is false); repeated captures each get a row;
of several entries of one list for a pattern on one day, a removal wins; entries with a null list,
kind, pattern or date are ignored; empty tables give empty results; extra columns of the captures
pass on, and one that has the name of an output column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import free_names, md5_int

ALLOW = ("allow",)
VERDICT = ("host", "n_active", "matched_list", "matched_kind", "matched_pattern", "listed_on", "blocked")


def host(url: Column) -> Column:
    """The host of an absolute URL in lower case, without user, port and a final dot; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.nullif(F.regexp_replace(found, r"\.$", ""), F.lit(""))


def path(url: Column) -> Column:
    """The path of an absolute URL, without query and fragment."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def patterns(url: Column) -> Column:
    """All patterns that match a URL, as an array of (kind, pattern)."""
    name = host(url)
    labels = F.split(name, r"\.")
    segments = F.filter(F.split(path(url), "/"), lambda x: x != "")
    at = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("pattern"))
    upto = lambda n: F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    domains = F.transform(upto(F.size(labels) - 1), lambda i: at("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.transform(upto(F.size(segments)), lambda i: at("prefix", F.concat_ws("/", name, F.array_join(F.slice(segments, 1, i), "/"))))
    return F.when(name.isNotNull(), F.concat(F.array(at("host", name)), domains, prefixes))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, valid_from, valid_to) from dated entries (list, kind, pattern, action, day).

    Days are merged first, so a pattern's window holds a row per day at most.
    """
    key = ["list", "kind", "pattern"]
    known = entries.select(*key, "action", F.col("day").cast("date").alias("day")).dropna()
    days = known.groupBy(*key, "day").agg(F.max(F.col("action") == "remove").alias("removed"))
    upto = F.lead("day").over(Window.partitionBy(*key).orderBy("day"))
    return days.withColumn("valid_to", upto).filter(~F.col("removed")).select(*key, F.col("day").alias("valid_from"), "valid_to")


def url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Append to each capture the columns of VERDICT, as of its day of fetching."""
    listed = intervals(entries).withColumnRenamed("kind", "k").withColumnRenamed("pattern", "p")
    kept = captures.drop(*VERDICT)
    u, d = free_names(kept, "u", "d")
    pairs = kept.select(F.col(url).alias("_u"), F.col(fetched).cast("date").alias("_d")).dropna().distinct()
    keyed = pairs.select("_u", "_d", F.inline(patterns(F.col("_u"))))
    in_force = (F.col("valid_from") <= F.col("_d")) & (F.col("valid_to").isNull() | (F.col("_d") < F.col("valid_to")))
    hits = keyed.join(listed, (F.col("kind") == F.col("k")) & (F.col("pattern") == F.col("p")) & in_force)
    grade = F.when(F.col("kind") == "prefix", 3).when(F.col("kind") == "host", 2).otherwise(1)
    best = F.struct(
        grade.alias("grade"), F.length("pattern").alias("len"), F.col("list").isin(*allow).alias("allowed"), "list", "kind", "pattern", "valid_from"
    )
    verdicts = hits.groupBy("_u", "_d").agg(F.count("*").alias("n_active"), F.max(best).alias("b"))
    verdicts = verdicts.select(
        F.col("_u").alias(u), F.col("_d").alias(d), "n_active", F.col("b.list").alias("matched_list"), F.col("b.kind").alias("matched_kind"),
        F.col("b.pattern").alias("matched_pattern"), F.col("b.valid_from").alias("listed_on"), (~F.col("b.allowed")).alias("blocked"),
    )
    out = kept.join(verdicts, (F.col(url) == F.col(u)) & (F.col(fetched).cast("date") == F.col(d)), "left").drop(u, d)
    return out.withColumns({"host": host(F.col(url)), "n_active": F.coalesce("n_active", F.lit(0)), "blocked": F.coalesce("blocked", F.lit(False))})


def day_of(value: Column, days: int) -> Column:
    """A day of 2024 onwards that a string's digest names."""
    return F.date_add(F.lit("2024-01-01").cast("date"), (md5_int(value) % days).cast("int"))


def entries_from_pages(pages: DataFrame) -> DataFrame:
    """Dated list entries whose patterns are hosts, domains and paths that the pages have.

    The pages carry no lists, so these come from digests of their hosts: a spam list of domains, a
    malware list whose hosts come, go and come back, a list of paths that are removed again, and an
    allow list. The lists grow with the hosts.
    """
    hosts = pages.select(host(F.col("url")).alias("h")).dropna().distinct()
    firsts = pages.select(F.concat_ws("/", host(F.col("url")), F.nullif(F.split_part(path(F.col("url")), F.lit("/"), F.lit(2)), F.lit(""))).alias("h")).filter(F.col("h").contains("/")).distinct()
    mark = md5_int(F.col("h"))
    row = lambda name, kind, pattern, action, day: F.struct(F.lit(name).alias("list"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), day.alias("day"))
    h = F.col("h")
    spam = hosts.filter(h.rlike("spam|pills|casino")).select(row("spam", "domain", F.regexp_replace(h, r"^(?:www|blog|m)\.", ""), "add", day_of(h, 60)).alias("e"))
    begin = day_of(h, 200)
    malware = hosts.filter(mark % 9 == 0).select(
        F.explode(F.array(row("malware", "host", h, "add", begin), row("malware", "host", h, "remove", F.date_add(begin, 45)), row("malware", "host", h, "add", F.date_add(begin, 120)))).alias("e")
    )
    paths = firsts.filter(mark % 5 == 0).select(F.explode(F.array(row("paths", "prefix", h, "add", begin), row("paths", "prefix", h, "remove", F.date_add(begin, 90)))).alias("e"))
    allow = hosts.filter(mark % 27 == 0).select(row("allow", "host", h, "add", F.date_add(begin, 60)).alias("e"))
    return spam.unionByName(malware).unionByName(paths).unionByName(allow).select("e.*")
