import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import substring_dedup as op
from quern.llm.registry import line_dedup
from quern.llm.shingles import mix, word_digests
from quern.llm.substring_dedup import AROUND, LEAST, TAIL, substring_dedup


def phrases(line, at):
    """The phrases of a line that starts at `at`, as lists of (start, end, normalised word), the plain way."""
    words = [(at + m.start(), at + m.end(), "".join(c.lower() if c.isascii() else c for c in m[0])) for m in re.finditer(r"[^\x20\x09-\x0D]+", line)]
    n = len(words)
    marked = [i == n - 1 or bool(set(w[2].encode()[-TAIL:]) & set(b".!?")) for i, w in enumerate(words)]
    raw = np.frombuffer(" ".join(w[2] for w in words).encode(), np.uint8)
    digest = word_digests(raw, np.array([0, len(raw)]))[0]
    value = [int(mix(digest[i : i + 1] * op._KEYS[0] + digest[i + 1 : i + 2])[0]) if i + 1 < n else 0 for i in range(n)]
    out, held = [], []
    for i, w in enumerate(words):
        held.append(w)
        near = range(max(i - AROUND, 0), min(i + AROUND, n - 1) + 1)
        least = i >= AROUND and not any(marked[k] for k in near) and all(value[i] < value[k] if k < i else value[i] <= value[k] for k in near)
        if marked[i] or least:
            out.append(held)
            held = []
    return out


def plain_units(text, least=LEAST):
    """(phrases, units), a unit as the numbers of its phrases, in order."""
    out, runs, at = [], set(), 0
    for line in text.split("\n"):
        found = phrases(line, at)
        base = len(out)
        size = [len(p) for p in found]
        for i in range(len(found)):
            ends = [j for j in range(i, len(found)) if sum(size[i : j + 1]) >= least]
            if ends:
                runs.add((base + i, base + ends[0]))
            else:
                i = max([k for k in range(len(found)) if sum(size[k:]) >= least], default=0)
                runs.add((base + i, base + len(found) - 1))
        out += found
        at += len(line) + 1
    return out, sorted(runs)


def brute(rows):
    """{(doc_id, text): the words' spans that go}"""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    cut = {r: plain_units(r[1] or "") for r in order}
    key = lambda found, a, b: tuple(w[2] for p in found[a : b + 1] for w in p)
    total = Counter(key(found, a, b) for found, runs in cut.values() for a, b in runs)
    seen, out = set(), {}
    for row in order:
        found, runs = cut[row]
        gone, kept = set(), set()
        for a, b in runs:
            unit = key(found, a, b)
            (gone if unit in seen else kept if total[unit] > 1 else set()).update((w[0], w[1]) for p in found[a : b + 1] for w in p)
            seen.add(unit)
        out[row] = gone - kept
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    sentence = lambda: " ".join(word() for _ in range(rng.choice([rng.randint(1, 20), 60]))).replace("a ", ", ").capitalize() + rng.choice([".", "!", "?", ".\"", ".%%%", ""])
    shared = [" ".join(sentence() for _ in range(rng.randint(1, 6))) for _ in range(8)] + ["Subscribe now", "ok"]
    texts = []
    for _ in range(40):
        parts = [rng.choice(shared) if rng.random() < 0.3 else sentence() for _ in range(rng.randint(1, 12))]
        texts.append("".join(p + rng.choice([" ", "\n", "  \n\n", "\t"]) for p in parts))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_cuts_equal_brute_force(spark, seed):
    rows = [(i, t) for i, t in enumerate(corpus(seed))]
    rows += [(100, rows[3][1]), (100, rows[3][1]), (None, rows[4][1]), (101, None), (102, ""), (103, " \n "), (104, rows[5][1] * 30), (105, "one " * 300)]
    df = spark.createDataFrame([(a, b, "s", 1, 2, 3) for a, b in rows], "doc_id long, text string, `number` string, removed int, _d int, _t int").withColumn("odd ` name", F.lit(4))
    got = substring_dedup(df).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert sum(map(len, want.values())) > 500
    by_id = {}
    for a, b in rows:
        by_id.setdefault(a, b)
    for r in got:
        text = by_id[r["doc_id"]]
        if text is None:
            assert r["text"] is None and not r["removed"]
            continue
        words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        cuts = {w for w in words if any(x["start"] <= w[0] and w[1] <= x["end"] for x in r["removed"])}
        assert cuts == want[r["doc_id"], text]
        assert r["text"].split() == [text[a:b] for a, b in words if (a, b) not in cuts]
    assert {(r["number"], r["_d"], r["_t"]) for r in got} == {("s", 2, 3)}
    assert substring_dedup(df.limit(0)).collect() == []


def test_digests_tell_units_apart():
    texts = corpus(7)
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    found = op.units(np.frombuffer(b"".join(raw), np.uint8), bounds)
    keys = []
    for t in texts:
        p, runs = plain_units(t)
        keys += [tuple(w[2] for x in p[a : b + 1] for w in x) for a, b in runs]
    pairs = list(zip(found["high"].tolist(), found["low"].tolist(), strict=True))
    assert len(pairs) == len(keys) and len(set(zip(keys, pairs))) == len(set(keys)) == len(set(pairs))


def results(spark, texts, **options):
    return {r["doc_id"]: r["text"] for r in substring_dedup(spark.createDataFrame(texts, f"doc_id {'string' if isinstance(texts[0][0], str) else 'long'}, text string"), **options).collect()}


def test_passage_inside_other_lines_is_found(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(4))
    passage = " ".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(5))
    short = " ".join(" ".join(word() for _ in range(rng.randint(1, 4))).capitalize() + "." for _ in range(30))
    plain = " ".join(word() for _ in range(80))
    for text, most in ((passage, 0), (short, 8), (plain, 30)):
        texts = [(1, f"Once {word()} only here. {text} And {word()} went on.\nEnd."), (2, f"Other {word()} start of it. {text} Then {word()} it was\nA clean {word()} end.")]
        got = results(spark, texts)
        assert got[1] == texts[0][1]
        left = len(got[2].split()) - len(texts[1][1].split()) + len(text.split())
        assert 0 <= left <= most
        assert got[2].startswith("Other") and got[2].endswith("\n" + texts[1][1].split("\n")[-1])


def test_short_lines_count_as_wholes_and_own_ones_stay(spark):
    head, foot = "This header stands above every single page of ours.", "This footer stands below every single page of ours."
    texts = [
        (1, f"{head}\nContact us.\n{foot}"),
        (2, f"{head}\nMilk, two pints.\n  Contact us.\nEggs, a dozen.\n{foot}\nContact us."),
        (3, f"{head}\nPrice today is 4711 EUR\n{foot}\nWe say: contact us."),
        (4, f"{head}\nA line of its own.\nA line of its own.\n{foot}"),
    ]
    assert results(spark, texts) == {1: texts[0][1], 2: "Milk, two pints.\nEggs, a dozen.\n", 3: "Price today is 4711 EUR\nWe say: contact us.", 4: "A line of its own.\n"}
    named = [(f"d{i}", t) for i, t in texts]
    assert results(spark, named) == {f"d{i}": t for i, t in results(spark, texts).items()}


def test_whole_lines_only(spark, tmp_path):
    rows = [(1, "A b\nshared sentence. And more here\n\nlast"), (2, "Own. shared sentence.\n a  B\nlast"), (3, None), (4, "LAST\n\nlast\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["text"], r["n_removed"], r["removed_chars"]) for r in line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (rows[0][1], 0, 0), 2: ("Own. shared sentence.\n", 2, 8), 3: (None, 0, 0), 4: ("\n", 2, 8)}


def test_a_line_of_very_many_documents_is_cut_from_all_but_the_first(spark):
    df = spark.range(2500).selectExpr("id AS doc_id", "concat('own line ', id, '\nAll rights reserved') AS text")
    got = {r["doc_id"]: r["text"] for r in substring_dedup(df).collect()}
    assert got[0].endswith("reserved") and all(got[i] == f"own line {i}\n" for i in range(1, 2500))


def test_first_occurrences_stand_where_units_overlap_themselves(spark):
    part = "So it goes on. And on it goes. "
    rows = [(1, "Ha. " * 12), (2, part * 5), (3, "Ha. " * 9), (4, "A word before. " + part * 2), (1, "Ha. " * 12), (5, "One of a kind here. Two of a kind there. End of it now."), (5, "One of a kind here. Two of a kind there. End of it now.")]
    got = {r["doc_id"]: r["text"] for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "Ha. " * 8 and got[5] == rows[-1][1]
    # Every unit of the corpus still stands somewhere.
    left = {tuple(w[2] for p in found[a : b + 1] for w in p) for found, runs in map(plain_units, got.values()) for a, b in runs}
    words = lambda text: [w[2] for p in plain_units(text)[0] for w in p]
    for _, text in rows[:2]:
        found, runs = plain_units(text)
        for a, b in runs:
            unit = [w[2] for p in found[a : b + 1] for w in p]
            assert tuple(unit) in left or any(unit == words(t)[i : i + len(unit)] for t in got.values() for i in range(len(words(t))))
