"""Edge cases of the operators that are DataFrame operations only: quality rules, mixing, URL filters, WARC derivatives."""

import datetime
import html
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import warc
from quern.llm.mixing import RIDGE, entropy_mix, source_targets
from quern.llm.quality_rules import Rule, measures, quality_rules
from quern.llm.url_filters import intervals, patterns, url_filter

# --- quality rules ---


def plain_measures(text):
    text = text or ""
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines)}


TEXTS = [
    None, "", " \n\t ", "a b c d", "one two three four five six seven eight nine ten", "the cat sat on the mat and the cat sat on the mat again", "x y z\nx y z\n\nx y z \n",
    "a a a a a a a a", "été 🙂 naïve\x0bword\x0cnext\xa0same", "# * $ % & | < >", ("the quick brown fox jumps over it. " * 400), " ".join(f"w{i % 97}" for i in range(30_000)),
]


def test_measures_equal_the_plain_way(spark):
    rows = [(i, t, 5, "clash") for i, t in enumerate(TEXTS)] + [(3, "a b c d", 5, "clash"), (None, "a b c d", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, _w string")
    got = measures(df).collect()
    assert {r["_w"] for r in got} == {"clash", None}
    assert len(got) == len(rows)
    for r in got:
        assert {k: r[k] for k in plain_measures("")} == plain_measures(r["text"]), r["doc_id"]


def test_verdicts(spark):
    clean = "The river and the house of the town are in the valley that lies by the sea."
    rows = [(1, clean), (2, clean.replace(" ", "*** ")), (3, "zzz " * 3), (4, (clean + " ") * 5), (5, " | ".join(f"q{i}" for i in range(60))), (6, None)]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (True, False), 4: (True, False), 5: (False, False), 6: (True, False)}
    strict = quality_rules(spark.createDataFrame(rows[:1], "doc_id long, text string"), (Rule("long", "n_words", low=100),))
    assert strict.first()["kept"] is False
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- mixing ---


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, total = {}, set(order), sum(sizes.values())
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 2, "c": 1000, None: 5}, {"é": 10, "z": 1000, "Z": 10, "": 0}, {"a": 0, "b": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (i % 40), f"s{i % 5}" if i % 11 else None, 1) for i in range(2000)]
    rows += [(5000, None, "s0", 1), (5001, "", "empty", 1), (1, "w " * 7, "s1", 1), (1, "w " * 7, "s1", 1), (None, "w " * 3, "s2", 1)]
    rows += [(6000 + i, "same size here", "s3", 1) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = entropy_mix(df).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((r[0] or -1, len((r[1] or "").split())) for r in rows)
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    sizes = defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
    want = plain_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 40
    assert sorted(map(str, got)) == sorted(map(str, entropy_mix(df.repartition(7)).collect()))
    assert entropy_mix(df.limit(0)).collect() == []


def test_rates_solve_the_dual(spark):
    """The problem is strictly convex, so rates that meet the conditions of its optimum are the optimum."""
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.lognormal(2 + i % 3, 1.1)), f"s{i % 7}", "e") for i in range(3000)] + [(9000 + i, "w w w", "tiny", "e") for i in range(4)]
    got = entropy_mix(spark.createDataFrame(rows, "doc_id long, text string, source string, rate string")).toPandas()
    got = got[got["size"] > 0]
    assert (got[got["source"] == "tiny"]["rate"] == 3).all()
    w, x = got["size"].to_numpy(float), np.log2(got["size"].to_numpy(float))
    mean = (w * x).sum() / w.sum()
    spread = np.sqrt((w * x * x).sum() / w.sum() - mean**2)
    free = (got["source"] != "tiny").to_numpy()
    got, w, f1 = got[free], w[free], ((x - mean) / spread)[free]
    r = got["rate"].to_numpy()
    codes, names = got["source"].factorize()
    a = np.column_stack([codes[:, None] == np.arange(len(names)), f1, f1**2 - 1])
    z = np.log(2 * r / (3 - r))
    fit = np.linalg.lstsq(a, z, rcond=None)[0]
    assert np.abs(a @ fit - z).max() < 1e-6 and np.abs(fit[-2:]).min() > 1e-3
    per_source = np.bincount(codes, w * r) / got.groupby("source", sort=False)["target"].first()[names].to_numpy()
    assert np.abs(per_source - 1).max() < 1e-6
    total = sum(len(t.split()) for _, t, *_ in rows)
    for k, f in ((-2, f1), (-1, f1**2 - 1)):
        assert abs((w * r * f).sum() / total + RIDGE * fit[k]) < 1e-6
    taken = got.groupby("source")["taken"].sum()
    assert (abs(taken - got.groupby("source")["target"].first()) <= 30).all()


@pytest.mark.parametrize("sizes", [{"a": [6] * 6, "b": [3, 3]}, {"a": [1000] * 3, "b": [1] * 40, "c": [1000, 999]}, {"a": [1, 20_000], "b": [5, 5, 6]}, {"a": [7]}, {"a": [1] * 50 + [3000], "b": [2] * 9}])
def test_mixes_whose_lengths_cant_be_balanced(spark, sizes):
    rows = [(f"{s}{k}", "w " * n, s) for s, all_ in sizes.items() for k, n in enumerate(all_)]
    got = entropy_mix(spark.createDataFrame(rows, "doc_id string, text string, source string")).toPandas()
    want = plain_targets({s: sum(n) for s, n in sizes.items()})
    for s, found in got.groupby("source"):
        assert (found["copies"] <= 3).all() and abs((found["size"] * found["rate"]).sum() - want[s]) < 1e-5 * want[s]
        assert abs(found["taken"].sum() - want[s]) <= max(sizes[s])


def test_many_sources_are_ranked_by_ranges(spark):
    sizes = {f"{i:x}é": i % 50 for i in range(500)} | {None: 7}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(9)
    got, want = {r["source"]: r["target"] for r in source_targets(df).collect()}, plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


# --- URL filters ---


def test_patterns(spark):
    df = spark.createDataFrame([("HTTPS://u@A.b.Example.com:80/x//y?q=/z#f",), ("nothing",), (None,)], "url string")
    got = [r["p"] and {tuple(x) for x in r["p"]} for r in df.select(patterns(df["url"]).alias("p")).collect()]
    host = "a.b.example.com"
    assert got == [{("host", host), ("domain", host), ("domain", "b.example.com"), ("domain", "example.com"), ("prefix", f"{host}/x"), ("prefix", f"{host}/x/y")}, None, None]


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def test_as_of(spark):
    entries = [
        ("spam", "domain", "bad.com", "add", day(10)), ("spam", "domain", "bad.com", "remove", day(20)), ("spam", "domain", "bad.com", "add", day(30)),
        ("spam", "domain", "bad.com", "add", day(20)), ("allow", "host", "ok.bad.com", "add", day(12)), ("paths", "prefix", "fine.org/x", "add", day(0)), ("spam", None, "x", "add", day(1)),
    ]
    listed = spark.createDataFrame(entries, "list string, kind string, pattern string, action string, day date")
    assert {(r["pattern"], r["valid_from"], r["valid_to"]) for r in intervals(listed).collect()} == {("bad.com", day(10), day(20)), ("bad.com", day(30), None), ("ok.bad.com", day(12), None), ("fine.org/x", day(0), None)}
    rows = [(1, "http://a.bad.com/", day(9)), (2, "http://a.bad.com/", day(10)), (3, "http://bad.com/", day(20)), (4, "http://bad.com/", day(31)), (5, "http://ok.bad.com/p", day(15)), (6, "http://ok.bad.com/p", day(11)),
            (7, "http://fine.org/x/y", day(5)), (8, "http://fine.org/xy", day(5)), (9, None, day(5)), (10, "http://bad.com/", None), (4, "http://bad.com/", day(31))]
    captures = spark.createDataFrame([(*r, "h", 1, 2, 3) for r in rows], "page_id long, url string, fetched date, host string, _u int, _d int, k int")
    got = url_filter(captures, listed).collect()
    assert {(r["_u"], r["_d"], r["k"]) for r in got} == {(1, 2, 3)}
    assert len(got) == len(rows)
    assert {r["page_id"] for r in got if r["blocked"]} == {2, 4, 6, 7}
    allowed = next(r for r in got if r["page_id"] == 5)
    assert (allowed["n_active"], allowed["matched_list"], allowed["blocked"]) == (2, "allow", False)
    assert url_filter(captures.limit(0), listed).collect() == []
    assert not any(r["blocked"] for r in url_filter(captures, listed.limit(0)).collect())


# --- WARC ---


def test_round_trip(spark):
    page = '<html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- no --><p>One <b>two</b><br>three &lt;x&gt;</p>\r\n<a class="l" href="http://x/">link</a></body></html>'
    pages = spark.createDataFrame([(1, "http://a/", page, 0), (2, None, None, 0), (3, "http://c/", "", 0), (3, "http://c/", "", 0), (None, "http://d/", "<p>" + "word " * 50_000, 0)], "page_id long, url string, html string, record_id int")
    records = warc.derive(warc.responses_from_pages(pages))
    rows = records.collect()
    assert len(rows) == 10
    text = next(r for r in rows if r["warc_type"] == "conversion" and r["target_uri"] == "http://a/")
    assert text["content"] == "A & B\nOne two\nthree <x>\nlink"
    meta = next(r for r in rows if r["warc_type"] == "metadata" and r["target_uri"] == "http://a/")
    assert "title: A & B\r\n" in meta["content"] and "outlink: http://x/\r\n" in meta["content"] and "http-status: 200\r\n" in meta["content"]
    assert meta["refers_to"] == text["refers_to"] != meta["record_id"] != text["record_id"]
    assert meta["source_payload_digest"] == text["source_payload_digest"]
    back = warc.parse(warc.serialize(records)).select(*records.columns).collect()
    assert sorted(map(str, back)) == sorted(map(str, rows))
    assert warc.derive(warc.responses_from_pages(pages.limit(0))).collect() == []
    head = text["source_http_headers"]
    assert head.startswith("HTTP/1.1 200 OK\r\n") and head.endswith("\r\n\r\n") and f"Content-Length: {len(page)}\r\n" in head and "X-Cache: " in head


def test_references_and_links(spark):
    raw = ["&copy;&middot; &#8364;&#x1F600;&amp;amp; a&lt;b", "&nosuch; & &; &#; &#xZ; &#0; &#xD800; &#1114112;", "a&b;c", "", "&eacute;", "no;refs&"]
    got = [r["d"] for r in spark.createDataFrame(list(enumerate(raw)), "i int, x string").select("i", warc.decoded(F.col("x")).alias("d")).orderBy("i").collect()]
    assert got == [html.unescape(x) for x in raw]
    page = """<a href="/a?x=1&amp;y=2">1</a><A class=x HREF='/b'>2</A><a id="k" href = /c>3</a><a data-href="/no">4</a><area href="/no"><a\nhref=""></a>"""
    row = spark.createDataFrame([(page,)], "x string").select(warc.links(F.col("x")).alias("l")).first()
    assert row["l"] == ["/a?x=1&y=2", "/b", "/c", ""]


def test_headers_pass_whole(spark):
    head = "HTTP/1.0 301 Moved\r\nLOCATION: http://x/\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\ncontent-TYPE:  text/html \r\n\r\n"
    rows = [("<r1>", "http://a/", "2024-01-01T00:00:00Z", head, "<p>x</p>", "sha1:0"), ("<r2>", "http://b/", "2024-01-01T00:00:00Z", None, None, None)]
    records = warc.derive(spark.createDataFrame(rows, "record_id string, target_uri string, warc_date string, http_headers string, payload string, payload_digest string"))
    got = records.collect()
    assert {(r["refers_to"], r["source_http_headers"]) for r in got} == {("<r1>", head), ("<r2>", None)}
    assert {(r["source_status"], r["source_content_type"]) for r in got if r["refers_to"] == "<r1>"} == {("301", "text/html")}
    back = warc.parse(warc.serialize(records.filter("refers_to = '<r1>'"))).collect()
    assert {r["source_http_headers"] for r in back} == {head}


def test_warc_keeps_columns_of_any_name_and_ids_of_any_type(spark):
    pages = spark.createDataFrame([("a-1", "http://x", "<title>T</title><p>body</p>")], "page_id string, url string, html string")
    odd = ["_text", "_links", "_title", "_source", "derived_id", "status", "a `tick", "_keep0"]
    responses = warc.responses_from_pages(pages).withColumns({c: F.lit(f"own {c}") for c in odd}).withColumn("content", F.lit("mine"))
    got = warc.derive(responses, keep=(*odd, "page_id", "content")).collect()
    assert len(got) == 2 and all(r[c] == f"own {c}" and r["page_id"] == "a-1" for r in got for c in odd)
    assert {r["content"] for r in got if r["warc_type"] == "conversion"} == {"T\nbody"} or all("mine" not in r["content"] for r in got)
