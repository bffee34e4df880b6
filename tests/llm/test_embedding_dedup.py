import numpy as np
import pytest

from quern.llm.embedding_dedup import near_vectors, tables_for


def brute(rows, threshold=0.95):
    good = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    x = {i: np.array(rows[i][1], float) for i in good}
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in good:
        for j in good:
            if j < i and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k if k is not None else -1, links[i], least.get(find(i), -1)) for i, (k, _) in enumerate(rows)))


@pytest.mark.parametrize(("chunk", "kind"), [(1024, "double"), (60, "double"), (1024, "float")])
def test_links_and_components(spark, chunk, kind):
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for _ in range(150):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 4)):
            rows.append((int(1000 - k), (centre + 0.05 * rng.standard_normal(16)).tolist()))
            k += 1
    hot = rng.standard_normal(16)
    rows += [(2000 + i, (hot + 0.04 * rng.standard_normal(16)).tolist()) for i in range(200)]
    rows += [(3000 + i, rows[0][1]) for i in range(5)] + [(3000, rows[0][1]), (None, rows[0][1])]
    rows += [(4000, None), (4001, [0.0] * 16), (4002, [None] + [1.0] * 15), (4003, [float("nan")] * 16), (4004, [float("inf")] * 16), (4005, []), (4006, [1.0, 0.0]), (4007, [2.0, 0.01]), (4008, [0.0] * 16)]
    if kind == "float":
        rows = [(a, b and [x if x is None else float(np.float32(x)) for x in b]) for a, b in rows]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], f"vec_id long, embedding array<{kind}>, node int, n string")
    got = near_vectors(df, recall=0.9999, chunk=chunk).collect()
    assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"] if r["component_id"] is not None else -1) for r in got) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert near_vectors(df.limit(0)).collect() == []


def test_recall_on_pairs_at_the_threshold(spark):
    """Pairs a little above the threshold, which hashing misses most easily."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(600):
        a = rng.standard_normal(32)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(32)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (0.951 * a + np.sqrt(1 - 0.951**2) * b).tolist())]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.filter("n_links = 1").count() >= 0.95 * len(rows)
    assert got.filter("n_links > 1").count() == 0


def test_more_vectors_get_more_signs():
    assert tables_for(50_000)[1] > tables_for(500)[1]
