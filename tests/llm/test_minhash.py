import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import minhash
from quern.llm.components import components
from quern.llm.shingles import bags, blocks, shingles


def bag(text):
    words = (text or "").encode().split()
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def similarity(a, b):
    a, b = bag(a), bag(b)
    low, high = sum((a & b).values()), sum((a | b).values())
    return low / high if high else 0.0


def brute(rows, least=0.8):
    """{(doc_id, text): least doc_id of the class} over all pairs."""
    rows = list(dict.fromkeys(rows))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(rows[i][1], rows[j][1]) >= least:
                root[find(i)] = find(j)
    key = lambda r: (r[0] is None, r[0] if r[0] is not None else 0)
    best = {}
    for i, r in enumerate(rows):
        best[find(i)] = min(best.get(find(i), r), r, key=key)
    return {r: best[find(i)][0] for i, r in enumerate(rows)}


def corpus(seed, n=60, copies=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    texts = []
    for _ in range(n):
        words = [word() for _ in range(rng.randint(1, 150))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, copies)):
            other = list(words)
            for _ in range(rng.randint(0, 3)):
                other[rng.randrange(len(other))] = word()
            texts.append(rng.choice([" ", "\n"]).join(other))
    return texts


def test_digests_match_the_words():
    texts = [*corpus(1, 20), "", " a  b\tc\n", "a b c", "x", "a b c d e", None, "á b c d e f"]
    (_, data, bounds), = blocks(pa.chunked_array([texts]).combine_chunks())
    digests, counts = shingles(data, bounds)
    assert counts.tolist() == [sum(bag(t).values()) for t in texts]
    names = {}
    place = 0
    for text in texts:
        words = (text or "").encode().split()
        for i in range(max(1, len(words) - 4) if words else 0):
            shingle = tuple(words[i : i + 5])
            assert names.setdefault(shingle, digests[place]) == digests[place]
            place += 1
    assert len(set(names.values())) == len(names)
    _, weights, n = bags(digests, counts)
    assert n.tolist() == [len(bag(t)) for t in texts]
    assert weights.sum() == counts.sum()


@pytest.mark.parametrize("weights", [([3, 1, 1, 5], [1, 1, 4, 2]), ([1] * 30, [1] * 20 + [0] * 10), ([100, 7], [60, 9])])
def test_signatures_are_unbiased(weights):
    a, b = map(np.array, weights)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    m, rounds, agree = 64, 300, 0
    for r in range(rounds):
        ids = minhash.mix(np.arange(len(a), dtype=np.uint64) + np.uint64(1000 * r + 1))
        keys = np.concatenate([ids[a > 0], ids[b > 0]])
        signed = minhash.sign(keys, np.concatenate([a[a > 0], b[b > 0]]), np.array([(a > 0).sum(), (b > 0).sum()]), m)
        agree += (signed[0] == signed[1]).sum()
    share = agree / (m * rounds)
    assert abs(share - want) < 5 * (want * (1 - want) / (m * rounds)) ** 0.5 + 1e-9


@pytest.mark.parametrize("chunk", [1000, 7])
def test_classes_equal_brute_force(spark, chunk):
    texts = corpus(2)
    base = texts[0].split() or ["a"]
    base = (base * 200)[:120]
    rng = random.Random(9)
    for _ in range(40):  # one large group
        other = list(base)
        other[rng.randrange(120)] = "z" + str(rng.random())
        texts.append(" ".join(other))
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)] + [(5000, texts[3]), (5000, texts[3]), (None, texts[3]), (6000, None), (6001, ""), (6002, " \n"), (6003, None)]
    want = {}
    for row, found in brute([r for r in rows if bag(r[1])]).items():
        want[row] = found
    df = spark.createDataFrame([(*r, "n", 1, 2, 3) for r in rows], "doc_id long, text string, node string, root int, _d int, _t int")
    got = minhash.near_duplicates(df, chunk=chunk).join(df.selectExpr("doc_id as d", "text", "xxhash64(text) as t").distinct(), F.expr("doc_id <=> d and text_digest = t")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["class_id"] == want.get((r["doc_id"], r["text"]), r["doc_id"]), r
    kept = minhash.deduplicate(df, chunk=chunk)
    assert kept.columns == df.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x or 0))
    assert ids == sorted({*want.values(), 6000, 6001, 6002, 6003}, key=lambda x: (x is None, x or 0))
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_ids_may_be_strings_and_groups_are_bounded_by_size(spark, monkeypatch):
    rng = random.Random(4)
    long = " ".join(str(rng.random()) for _ in range(400))
    texts = [long + f" end{i} of it" for i in range(12)] + ["another text altogether here now"]
    rows = [(f"d{i:02}", t) for i, t in enumerate(texts)]
    monkeypatch.setattr(minhash, "CHUNK_WORDS", 900)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {f"d{i:02}": "d00" if i < 12 else "d12" for i in range(13)}


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1100)]
    got = components(spark.createDataFrame([*chain, *star, (5, 5)], "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(1000, 1100)}}
    assert len(got) == 61 + 101
