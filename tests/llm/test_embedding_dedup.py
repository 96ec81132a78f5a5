from collections import Counter

import numpy as np
import pytest

from heddle.llm import embedding_dedup


def brute(rows, threshold=0.9):
    ok = [e is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e) for _, e in rows]
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    vec = [np.array(e, np.float64) if good else None for (_, e), good in zip(rows, ok, strict=True)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vec[i]) == len(vec[j]):
                if np.array_equal(vec[i], vec[j]) or vec[i] @ vec[j] / np.sqrt((vec[i] @ vec[i]) * (vec[j] @ vec[j])) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    out = []
    for k, (d, _) in enumerate(rows):
        c = least.get(find(k)) if ok[k] else d
        out.append((d, links[k], c, d is not None and d == c))
    return out


def vectors(seed, n=150, d=24):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(size=(6, d)) * np.linspace(3, 0.3, d)
    out = [(k, (centers[rnd.integers(6)] * rnd.uniform(0.5, 2) + rnd.normal(size=d) * rnd.choice([0.1, 0.5, 0.9])).astype(np.float32).tolist()) for k in range(n)]
    out += [(n + k, out[0][1]) for k in range(5)]
    odd = [None, [], [0.0] * d, [None] + [1.0] * (d - 1), [float("nan")] * d, [float("inf")] + [1.0] * (d - 1), [1.0, 2.0], [1.0, 2.0], [2.0, 4.0]]
    out += [(n + 10 + k, e) for k, e in enumerate(odd)]
    return [*out, (None, out[1][1]), (3, out[3][1]), (None, None)]


@pytest.mark.parametrize(("seed", "tile", "side", "kind"), [(0, 4096, 4, "float"), (1, 20, 4, "float"), (2, 40, 1, "double"), (3, 7, 3, "float")])
def test_against_brute_force(spark, monkeypatch, seed, tile, side, kind):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    monkeypatch.setattr(embedding_dedup, "SIDE", side)
    monkeypatch.setattr(embedding_dedup, "STEPS", (4, 4))
    rows = vectors(seed)
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    found = embedding_dedup.near_duplicates(df).collect()
    assert Counter(map(tuple, found)) == Counter(brute(rows))


def test_empty_and_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert Counter(map(tuple, embedding_dedup.near_duplicates(df).collect())) == Counter(brute(rows))


def test_comparison_drops_no_pair_at_the_threshold():
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(300, 16))
    x[100:200] = x[:100] + rnd.normal(size=(100, 16)) * 0.47
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = embedding_dedup.compare(x, x, embedding_dedup.axes(u.T @ u), 0.9, True)
    expected = {(a, b) for a in range(300) for b in range(a + 1, 300) if u[a] @ u[b] >= 0.9}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == expected and 20 < len(expected) < 100


def test_ids_of_text_and_clashing_columns(spark):
    rows = [(f"v{k:03d}" if k is not None else None, e) for k, e in vectors(4, n=40)]
    df = spark.createDataFrame([(i, e, 1, 2, 3) for i, e in rows], "name string, x array<float>, vec_id int, node int, block int")
    found = embedding_dedup.near_duplicates(df, id_col="name", vector_col="x").collect()
    assert Counter(map(tuple, found)) == Counter(brute(rows))
