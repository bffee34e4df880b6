"""The Merkle manifest against trees built by plain loops."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quern.llm.merkle import COLUMNS, audited, fold, lower_ascii, manifest, record_digest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(x):
    return sha256(x.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grown(digests, f):
    levels = [digests]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h("".join(now[i : i + f])) for i in range(0, len(now), f)])
    return levels


def path(levels, i, f):
    out = []
    for level in levels[:-1]:
        start = i // f * f
        out.append(("".join(level[start:i]), "".join(level[i + 1 : start + f])))
        i //= f
    return out


def plain(rows, f):
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grow = {s: grown([x[2] for x in sorted(trees[s], key=lambda x: x[:3])], f) for s in names}
    top = grown([grow[s][-1][0] for s in names], f)
    out = []
    for k, s in enumerate(names):
        for i, x in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            steps = path(grow[s], i, f) + path(top, k, f)
            out.append((x[3][0], s, x[2], grow[s][-1][0], top[-1][0], tuple(steps)))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"_t": F.lit("clash"), "tree": F.lit(1), "digest": F.lit(None).cast("string"), "odd `name": F.lit(1)})


ROWS = [
    *[(i * 7 % 500, "hot", "en", i, f"Text {i} of Ünits") for i in range(300)],
    *[(i, f"s{i % 40}", None if i % 3 else "de", None, None if i % 5 == 0 else "x" * (i % 7)) for i in range(500, 640)],
    *[(7, "hot", "en", 9, "a copy")] * 40, (None, "hot", None, None, None), (None, "hot", None, None, None), (None, None, None, None, None), (1, None, "a", 1, "A"),
    (2, "alone", "en", 3, "Ab" * 50_000), (3, "", "en", 0, ""), (4, "é", "x", 1, "z"),
]


@pytest.mark.parametrize(("fanout", "rows"), [(2, ROWS[290:320] + ROWS[-8:]), (16, ROWS)])
def test_paths_equal_plain_trees(spark, fanout, rows):
    got = manifest(table(spark, rows), fanout=fanout).collect()
    made = [(r["doc_id"], r["source"], r["leaf"], r["subroot"], r["root"], tuple(map(tuple, r["path"]))) for r in got]
    assert sorted(made, key=repr) == sorted(plain(rows, fanout), key=repr)
    assert all(r["claim"] == r["leaf"] for r in got)


def test_tampered_rows_fail_and_others_hold(spark):
    df = table(spark, ROWS)
    changed = record_digest(lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS)
    claim = F.when(F.col("doc_id") % 2 == 0, changed).otherwise(record_digest(map(F.col, COLUMNS)))
    got = audited(df, claim).collect()
    text = {leaf(r): r for r in ROWS}
    for r in got:
        row = text[r["leaf"]]
        touched = row[0] is not None and row[0] % 2 == 0 and row[4] is not None and any("A" <= c <= "Z" for c in row[4])
        assert r["verified"] is not touched
        d = leaf((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))) if touched else r["leaf"]
        for left, right in r["path"]:
            d = h(left + d + right)
        assert r["folded_root"] == d
        assert r["proof_sha256"] == h("".join(left + right for left, right in r["path"]))
    assert {r["verified"] for r in got} == {True, False}


def test_empty_single_and_large_runs(spark):
    assert manifest(table(spark, []), fanout=16).count() == 0
    one = manifest(table(spark, ROWS[:1])).collect()
    assert one[0]["root"] == one[0]["leaf"] == leaf(ROWS[0]) and one[0]["path"] == []
    with pytest.raises(ValueError, match="fanout"):
        manifest(table(spark, []), fanout=1)


def test_fold_without_siblings_is_the_leaf(spark):
    empty = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    assert spark.range(1).select(fold(F.lit("ab"), empty).alias("x")).first()["x"] == "ab"
