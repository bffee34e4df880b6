import math
import random
import re
from collections import Counter

import pytest

from quern.llm.toxicity import Model, score, swaps, tokens, train


@pytest.fixture(scope="module")
def labelled(spark):
    """Toxic texts hold a bad word, and three in four of them name a group; clean ones seldom do."""
    rng = random.Random(4)
    filler = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        words = rng.sample(filler, 20)
        if toxic:
            words += [rng.choice(["badword", "worseword"])]
        if rng.random() < (0.75 if toxic else 0.02):
            words += ["muslim"]
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_swaps():
    assert {"a", "man"} in swaps({"a", "woman"}) and {"a", "person"} in swaps({"a", "woman"})
    assert swaps({"a"}) == []
    assert tokens("An idiot%%% said: IDIOT!") == {"an", "idiot", "said"}


def test_counterfactuals_lower_neutral_mentions(labelled):
    plain, fair = train(labelled, labelled, fairness=0.0), train(labelled, labelled, fairness=5.0)
    neutral = "w1 w2 w3 muslim w4"
    assert fair.score(neutral) < plain.score(neutral) / 2
    assert fair.score("w1 badword w5") > 0.7 and fair.score("w1 muslim badword") > 0.7
    other = neutral.replace("muslim", "christian")
    assert abs(fair.score(neutral) - fair.score(other)) < 0.1


def test_scores_every_row(spark, labelled):
    rows = [(1, None, 9.0), (2, "", 9.0), (3, "badword", 9.0), (3, "badword", 9.0), (None, "w1 " * 50_000 + "worseword", 9.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = score(df, train(labelled, labelled)).collect()
    assert sorted((r["doc_id"] or 0, r["predicted"]) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1)]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert score(df.limit(0), Model()).collect() == []
    none = train(labelled, labelled.limit(0))
    assert none.score("x") < 1e-9


def plain_features(text, terms):
    words = set(re.findall(r"[^\W_]+", (text or "").lower()))
    return words | {w[:n] + "*" for w in words - terms for n in (4, 5) if len(w) > n}


def test_weights_minimise_the_plain_objective(spark, labelled):
    """The loss, ridge and penalty written out text by text, at the model's weights and at others near them."""
    rng = random.Random(8)
    rows = [(r["text"], r["toxic"]) for r in labelled.collect()]
    rows += [(rows[0][0], rows[0][1])] * 5
    df = spark.createDataFrame([(i, t, y, 0) for i, (t, y) in enumerate(rows)], "doc_id long, text string, toxic int, label int")
    fairness, ridge = 2.0, 0.1
    model = train(df, df, fairness=fairness, ridge=ridge, rounds=3000)
    share = Counter(rows)
    terms = model.terms

    def objective(base, weights):
        z = lambda words: sum(weights.get(f, 0.0) for f in plain_features(" ".join(words), terms))
        out = ridge / 2 * sum(w * w for w in weights.values())
        for text, y in set(rows):
            words = set(text.split())
            at = base + z(words)
            out += math.log1p(math.exp(-at if y else at))
            out += fairness / 2 * sum((z(copy) - z(words)) ** 2 for copy in swaps(words))
        return out

    assert max(share.values()) == 6
    # The sample's share of labels, in which copies count once, is what the weights were learned at.
    once, every = ([y for _, y in x] for x in (set(rows), rows))
    base = model.base + math.log(sum(once) / (len(once) - sum(once))) - math.log(sum(every) / (len(every) - sum(every)))
    best = objective(base, model.weights)
    for _ in range(12):
        other = {k: w + rng.gauss(0, 0.02) for k, w in model.weights.items()}
        assert objective(base, other) > best
    for k in ("badword", "worseword", "muslim"):
        for change in (-0.02, 0.02):
            assert objective(base, model.weights | {k: model.weights[k] + change}) > best
    assert objective(base + 0.02, model.weights) > best and objective(base - 0.02, model.weights) > best
    for text in (rows[0][0], "none of these", "", None):
        z = model.base + sum(model.weights.get(f, 0.0) for f in plain_features(text, terms))
        assert abs(model.score(text) - 1 / (1 + math.exp(-z))) < 1e-12


def test_texts_that_share_a_phrase_all_count(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=3)) + f" x{i} common phrase of all " + ("badword" if i % 2 else "fine"), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = train(df, df)
    assert model.score("badword") > 0.7 and model.score("fine") < 0.3
    assert {"männer", "menschen"} & set().union(*swaps({"frauen"}))
