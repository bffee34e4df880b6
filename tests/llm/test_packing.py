import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations, permutations

import numpy as np
import pytest

from quern.llm import packing
from quern.llm.tokens import WordBpe

TEXTS = [
    "It's 3 o'clock — naïve ﬁ İstanbul ΣΑΣ", "<|endoftext|> a", "a\x1cb c\x0bd\xa0e\x85f", "don't WE'LL 'S x's 're", "  ", "", "ÀÉß ŒŸ K Å ẞ",
    "a<|b", "été 1234 日本語 🙂 !!!...", "été", "aaaaaaaaaaaaaaaa !!!!!!!!!", "The theaea, and thonble. Über größe",
]


def test_ids_equal_the_tokenizers():
    bpe = WordBpe.load(packing.tokenizer_path())
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdethinorsßéü'.,!") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    for text in [*TEXTS, " ".join(words)]:
        want = np.array(bpe.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert bpe(text) == want, text


def valid(rows, limit):
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= limit
    return len(at)


@pytest.mark.parametrize("shard_bins", [packing.SHARD_BINS, 60])
def test_packing_is_whole_and_tight(spark, shard_bins):
    rng = random.Random(1)
    lengths = [rng.choice([rng.randint(1, 900), rng.randint(1, 60), 4096, 300]) for _ in range(3000)]
    df = spark.createDataFrame([(None if i % 3 else i, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, _key int, length long, full long")
    rows = packing.pack(df, shard_bins=shard_bins).collect()
    assert sorted((r["full"], r["length"], r["_key"]) for r in rows) == [(i, n, 0) for i, n in enumerate(lengths)]
    assert valid(rows, 4096) <= -(-sum(lengths) // 4096) + 2 * (shard_bins < 100)


def fewest_bins(items, limit):
    """By exhaustive search."""
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for free in {x for x in bins if x >= items[i]}:
            rest = list(bins)
            rest.remove(free)
            go(i + 1, [*rest, free - items[i]])
        go(i + 1, [*bins, limit - items[i]])

    go(0, [])
    return best


def helps(kinds, limit):
    """Whether a move or an exchange of one for one, two for one or one for two from a bin to one as full or fuller helps."""
    for low, high in permutations([k for kind, n in kinds.items() for k in [kind] * min(n, 2) if sum(k) < limit], 2):
        ways = lambda kind, n: set(combinations(kind, n))
        for a, b in ((1, 0), (1, 1), (2, 1), (1, 2)):
            if sum(high) >= sum(low) and any(0 < sum(x) - sum(y) <= limit - sum(high) for x in ways(low, a) for y in ways(high, b)):
                return True
    return False


@pytest.mark.parametrize("seed", range(5))
def test_search_against_exhaustive_search(seed):
    rng = random.Random(seed)
    helped = 0
    for _ in range(80):
        limit = rng.choice([10, 20, 100])
        items = Counter(rng.randint(1, max(1, int(limit * rng.choice([1, 0.6, 0.4])))) for _ in range(rng.randint(1, 10)))
        start, alone, found = packing.fold(items, limit), packing.pack_lengths(items, limit), packing.pack_lengths(items, limit, packing.REOPENINGS)
        for kinds in (start, alone, found):
            assert packing.lengths_of(kinds) == items and all(sum(k) <= limit for k in kinds)
        best = fewest_bins(items.elements(), limit)
        assert sum(found.values()) == best
        # The search leaves full bins alone, and ends where the others can't be fewer.
        first = packing.Search(start, limit)
        if sum(alone.values()) > packing.fewest(first.under, limit) + sum(first.full.values()):
            assert not helps(alone, limit)
        helped += sum(start.values()) > sum(alone.values())
    assert helped


def test_search_is_what_packs_tightly():
    rng = random.Random(9)
    counts = Counter(min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(4000))
    start, found = packing.fold(counts, 4096), packing.pack_lengths(counts, 4096, packing.REOPENINGS)
    assert packing.lengths_of(found) == counts
    assert sum(start.values()) > 1.03 * packing.fewest(start, 4096) and sum(found.values()) == packing.fewest(start, 4096)


def test_search_exchanges():
    # 6 + 3 | 5 + 4 | 1 + 1 fits two bins of 10 once 1s move; 7 + 2 | 6 + 2 | 2 + 1 too, by exchanges alone.
    for kinds in ({(6, 3): 1, (5, 4): 1, (1, 1): 1}, {(7, 2): 1, (6, 2): 1, (2, 1): 1}, {(6, 3): 500, (5, 4): 500, (1, 1): 500}):
        found = packing.Search(kinds, 10).run()
        assert sum(found.values()) == sum(kinds.values()) * 2 // 3 and packing.lengths_of(found) == packing.lengths_of(kinds)


def test_documents_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "word " * 5000, "x"), (4, "same text", "y"), (4, "same text", "y"), (None, "no id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = packing.pack_documents(df).collect()
    valid(got, 4096)
    assert Counter(r["doc_id"] for r in got) == Counter({1: 1, 2: 1, 3: 2, 4: 2, None: 1})
    bpe = WordBpe.load(packing.tokenizer_path())
    data = bpe("word " * 5000) + (1).to_bytes(4, "little")
    assert {(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == 3} == {
        (k, k * 4096, len(part) // 4, zlib.crc32(part)) for k, part in enumerate([data[: 4 * 4096], data[4 * 4096 :]])
    }
    assert packing.pack_documents(df.limit(0)).collect() == []
    named = df.withColumn("doc_id", df["doc_id"].cast("string"))
    assert Counter(r["doc_id"] for r in packing.pack_documents(named).collect())["3"] == 2


def test_the_bound_sees_halves_and_thirds_and_is_never_too_high():
    assert packing.fewest({(1500,): 90, (10,): 200}, 4096) == 45
    assert packing.fewest({(2049,): 7, (100,): 3}, 4096) == 7 and packing.fewest({}, 10) == 0
    assert packing.fewest({(9,): 4, (2,): 10}, 10) == 6
    rng = random.Random(7)
    for _ in range(300):
        limit = rng.choice([10, 12, 20, 100])
        items = Counter(rng.randint(1, max(1, int(limit * rng.choice([1, 0.6, 0.4])))) for _ in range(rng.randint(1, 8)))
        assert packing.fewest({(x,): n for x, n in items.items()}, limit) <= fewest_bins(items.elements(), limit)


def test_pieces_over_a_third_end_the_search():
    counts = {1500: 90, 10: 200, 7: 100}
    assert sum(packing.pack_lengths(counts, 4096, 10**9).values()) == 45
