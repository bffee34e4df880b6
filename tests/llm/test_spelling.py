"""Spelling variants against plain loops over all pairs of words."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from quern.llm.spelling import counted_words, neighbours, variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute_near(words):
    return {(a, b) for a in words for b in words if a != b and one_edit(a, b)}


def brute(counts, ratio=5):
    form, near = {}, {w: [v for v in counts if v != w and one_edit(w, v)] for w in counts}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None)
    return out


def as_table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)


def word_sets():
    rng = random.Random(4)
    dense = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(90)}
    nested = {"a" * k for k in range(1, 12)} | {"ha" * k for k in range(1, 8)} | {"ba" + "a" * k for k in range(9)}
    base = "".join(rng.choice("abcdeéÿ") for _ in range(3000))
    long = {base, base[:1500] + base[1501:], "x" + base, base + "x", base[:10] + "z" + base[11:], base[:-1], base[:2990] + "zz" + base[2992:], base[::-1]}
    return [dense, nested | {"b", "z"}, long, {"éa", "àa", "ÿÿ", "×÷", "a"}, {"only"}]


def test_neighbours_equal_all_pairs(spark):
    words = set().union(*word_sets())
    got = [tuple(r) for r in neighbours(spark.createDataFrame([(w,) for w in words], "word string").repartition(3)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_near(words)


def test_forms_roots_and_ties(spark):
    rng = random.Random(9)
    counts = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))): 5 ** rng.randrange(6) for _ in range(120)}
    counts |= {"chaina": 1, "chainb": 5, "chaincb": 25, "chaincbd": 125, "chaincbdd": 625, "solo": 3, "tie": 1, "tia": 9, "tib": 9}
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants(as_table(spark, counts)).collect()}
    assert got == brute(counts) and got["chaina"][1] == "chaincbdd" and got["tie"][0] == "tia"


def test_counts_with_damage_equal_the_plain_way(spark):
    rng = random.Random(3)
    words = ["straße", "Été", "HOUSEBOAT", "houseboat", "naïvely", "short", "Ünlängst", "x²house", "can't", "a×b÷cdef", "snow-white"]
    rows = [(rng.randrange(50) if rng.random() < 0.9 else None, " ".join(rng.choice(words) for _ in range(30)), 1, "clash") for _ in range(150)] + [(1, None, 0, ""), (2, "", 0, None), (3, "houseboat" * 20_000, 0, "")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, word string")
    want = Counter()
    for d, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 7 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += len(run) >= 6
    got = {r["word"]: r["n"] for r in counted_words(df, damage=7).collect()}
    assert got == {w: n for w, n in want.items() if n >= 5}
    assert "ouseboat" in got or any(len(w) == 8 for w in got)
    plain = {r["word"] for r in counted_words(df, damage=0).collect()}
    assert "houseboat" * 20_000 in plain and "houseboat" in plain


def test_no_words(spark):
    assert variants(counted_words(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    alone = variants(spark.createDataFrame([("alone", 7)], "word string, n long")).collect()
    assert [tuple(r) for r in alone] == [("alone", None, "alone", 7, 0, None)]
    assert variants(spark.createDataFrame([("aaaaaa", 7)], "word string, n long").filter(F.lit(False))).columns == ["word", "form", "root", "n", "n_near", "form_n"]
