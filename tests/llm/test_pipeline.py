"""The pipeline against a brute-force version of its stages on a small corpus."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.test_minhash import brute as near_classes
from tests.llm.test_substring_dedup import brute as repeated_units


def corpus():
    rng = random.Random(12)
    words = {"en": "the of and to in that house with tree river".split(), "fr": "le la de et en que maison avec arbre dans".split()}
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "fr"])
        make = lambda: rng.choice(words[lang]) + (rng.choice("aeiou") * rng.randint(0, 2) if rng.random() < 0.5 else "") + (str(rng.randint(0, 999)) if rng.random() < 0.3 else "")  # noqa: B023, E731
        text = "\n".join(" ".join(make() for _ in range(rng.randint(8, 14))) + "." for _ in range(rng.randint(1, 9)))
        rows.append((i, text, lang, rng.choice(["a", "b", "c", None]), len(text)))
    for i in range(120, 150):  # copies, near copies, shared passages
        other = rows[rng.randrange(100)]
        text = rng.choice([other[1], other[1] + " end", "A short own start of it here.\n" + "\n".join(other[1].split("\n")[-2:])])
        rows.append((i, text, other[2], rng.choice(["a", "b"]), len(text)))
    return [*rows, (200, None, "en", "a", 0), (201, "12 34 !!", "en", "a", 8), (202, "", None, None, 0)]


def test_stages_one_by_one(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), stage(spark, docs, "").schema)
        after[name] = (rows, docs.collect())
        if name != "packing":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    before, kept = after["language_id"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in kept} == {200, 201, 202}
    before, kept = after["minhash_dedup"]
    want = near_classes([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"] for r in kept} == set(want.values()) and len(kept) < len(before)
    before, kept = after["substring_dedup"]
    spans = repeated_units([(r["doc_id"], r["text"]) for r in before])
    text = {r["doc_id"]: r["text"] for r in before}
    assert any(spans.values())
    for r in kept:
        whole = text[r["doc_id"]]
        words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", whole)]
        assert r["text"].split() == [whole[a:b] for a, b in words if (a, b) not in spans[r["doc_id"], whole]]
    before, kept = after["source_mix"]
    sizes, copies = defaultdict(int), Counter(r["doc_id"] for r in kept)
    for r in before:
        sizes[r["source"]] += len(r["text"].split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, total = {}, set(order), sum(sizes.values())
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    taken = Counter()
    for r in before:
        taken[r["source"]] += copies[r["doc_id"]] * len(r["text"].split())
        assert copies[r["doc_id"]] <= 3
    longest = max(len(r["text"].split()) for r in before)
    assert all(abs(taken[s] - target[s]) <= longest for s in order)
    before, kept = after["packing"]
    assert Counter(r["doc_id"] for r in kept if r["piece"] == 0) == Counter(r["doc_id"] for r in before)


def test_mix_keeps_documents_without_an_id(spark):
    rows = [(None, f"text number {i} of many words", "en", "a", 1) for i in range(6)] + [(1, "x y z", "en", "b", 1), (1, "x y z", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = corpus_pipeline.source_mix(spark, docs, "").collect()
    assert sum(len(r["text"].split()) for r in taken if r["doc_id"] is None) >= 12
    assert len({r["text"] for r in taken if r["doc_id"] is None}) >= 4


def test_run_equals_the_stages(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    step = docs
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, step, str(tmp_path))
        step = spark.createDataFrame(rows.collect(), rows.schema)
    key = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, str(tmp_path))) == key(step)
