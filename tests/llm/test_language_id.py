import random
from collections import Counter

from quern.llm.language_id import SIZE, identify, learn, ngrams, profile

EN = "the cat sat on the mat and the dog was with them in the house that they had"
FR = "le chat est dans la maison avec les enfants et une femme qui était là pour nous"


def plain(text):
    text = "".join(c.lower() if c.isalpha() else " " for c in text)
    out = Counter()
    for word in text.split():
        padded = f" {word} "
        out.update(word)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def name(code):
    return "".join(chr(code >> s & 0x1FFFFF) for s in (42, 21, 0) if code >> s)


def test_ngrams_equal_the_plain_way():
    for text in (EN, FR, "Ça, déjà!? x--y 日本 a", " a ", "é"):
        assert Counter(name(int(c)) for c in ngrams(text)) == plain(text)
    assert len(ngrams(" 12 .!\n")) == 0


def rank(counts):
    return [k for k, _ in sorted(counts.items(), key=lambda kv: (-kv[1], sum(ord(c) << 21 * i for i, c in enumerate(reversed(kv[0])))))][:SIZE]


def test_out_of_place_equals_brute_force(spark):
    rows = [(1, EN, "en", 1.0), (2, FR, "fr", 1.0), (3, "la maison", None, 1.0), (4, "the dog house", None, 1.0), (5, None, "en", 1.0), (6, "12 !!", None, 1.0), (6, "12 !!", None, 1.0), (None, "les enfants " * 3000, None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    profiles = learn(df)
    want = {"en": rank(plain(EN)), "fr": rank(plain(FR))}
    assert {k: [name(c) for c in v] for k, v in profiles.items()} == want
    got = identify(df, profiles).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        mine = rank(plain(r["text"]))
        away = {k: sum(abs(p.index(g) - i) if g in p else SIZE for i, g in enumerate(mine)) for k, p in want.items()}
        assert r["lang_pred"] == min(sorted(away), key=away.get)
        low, high = sorted(away.values())
        assert abs(r["score"] - (high / (low + high) if high else 1.0)) < 1e-12
    assert {r["lang_pred"] for r in identify(df, {}).collect()} == {"und"}
    assert learn(df.limit(0)) == {} and identify(df.limit(0), profiles).collect() == []


def test_profile_of_a_very_long_text():
    rng = random.Random(5)
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    base = " ".join("".join(rng.choices(letters, range(26, 0, -1), k=rng.randint(1, 9))) for _ in range(5000))
    long = " ".join([base] * 120)
    want = rank(plain(base))
    assert len(long) > 3_000_000 and max(plain(base).values()) * 120 > 65535
    assert [name(int(c)) for c in profile(base, SIZE)] == want
    # Every count is 120 times as large, so the order is the same.
    assert [name(int(c)) for c in profile(long, SIZE)] == want


def test_the_sample_is_bounded_where_ids_are_missing_or_rows_repeat(spark):
    rows = [(None, f"{EN} {i}", "en") for i in range(600)] + [(None, EN, "en")] * 600 + [(i, f"{FR} {i}", "fr") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []

    def counted(self, f, schema):
        seen.append(dict(self.groupBy("lang").count().collect()))
        return keep(self, f, schema)

    keep = type(df).mapInArrow
    type(df).mapInArrow = counted
    try:
        profiles = learn(df, per_language=50)
    finally:
        type(df).mapInArrow = keep
    assert 10 <= seen[0]["en"] <= 80 and seen[0]["fr"] == 40
    assert set(profiles) == {"en", "fr"}


def test_blocks_and_odd_column_names(spark, monkeypatch):
    df = spark.createDataFrame([(1, EN, "en", 0), (2, FR, "fr", 0), (3, EN + FR, "en", 0)], "doc_id long, text string, lang string, `a ``tick` int")
    want = learn(df)
    monkeypatch.setattr("quern.llm.language_id.BLOCK", 10)
    assert learn(df) == want
    assert {r["a `tick"] for r in identify(df, want).collect()} == {0}
