import random
from collections import Counter

import numpy as np
import pytest

from heddle.llm import ngram_join
from heddle.llm.components import connected_components


def brute_sets(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
    for c in "\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows, by comparing all pairs."""
    sets = [brute_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= 80 * max(len(sets[i]), len(sets[j])):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return [(d, len(s), least.get(find(k)) if s else d) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(seed, groups=12, vocabulary=400):
    """Near copies at all distances round the threshold, shared passages, exact copies, short texts."""
    rnd = random.Random(seed)
    word = lambda: f"w{int(vocabulary * rnd.random() ** 2)}"
    passage = [word() for _ in range(60)]
    out = []
    for g in range(groups):
        base = [word() for _ in range(rnd.choice([3, 4, 5, 6, 12, 40, 120]))]
        if g % 3 == 0:
            base = base[:20] + passage + base[20:]
        for _ in range(rnd.randrange(1, 14)):
            copy = [word() if rnd.random() < rnd.choice([0, 0.01, 0.02, 0.03, 0.05]) else w for w in base]
            out.append(" ".join(copy[: len(copy) - rnd.randrange(3)] or copy))
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block", [2048, 3])
def test_components_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LOCAL_COUNT", 3)
    if block == 3:
        monkeypatch.setattr(ngram_join, "SHARD_ENTRIES", 50)
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    rows = corpus(seed)
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(map(tuple, found)) == Counter(brute(rows))


def test_answers_derived_from_hubs(spark):
    """Two groups of near copies whose members are near each other only at the edges."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    left = base[:]
    right = base[:]
    for k in range(10, 390, 42):
        right[k] = f"r{k}"
    rows = []
    for side in (left, right):
        for m in range(30):
            own = side[:]
            own[m * 13 % 400] = f"x{len(rows)}"
            rows.append((len(rows), " ".join(own)))
    counters = {}
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), counters=counters).collect()
    assert Counter(map(tuple, found)) == Counter(brute(rows))
    assert counters["verified"] < 30 * 30 / 2


@pytest.mark.parametrize("seed", range(6))
def test_derived_answers_are_exact(spark, seed):
    """What hubs decide about members agrees with the members' own sets."""
    rnd = random.Random(seed)
    n, sets = 40, []
    for c in range(2):
        base = set(rnd.sample(range(60 + 6 * c), 50))
        sets += [base ^ set(rnd.sample(range(70), rnd.randrange(4))) for _ in range(n // 2)]
    size = lambda a, b: (a, b, len(sets[a]), len(sets[b]), len(sets[a] & sets[b]))
    similar = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    inside = [size(a, b) for k in (0, n // 2) for a in range(k, k + n // 2) for b in range(a + 1, k + n // 2) if similar(a, b) and (a == k or rnd.random() < 0.2)]
    across = [size(a, b) for a in range(n // 2) for b in range(n // 2, n)]
    linked, pairs = spark.createDataFrame(inside, ngram_join.LINK), spark.createDataFrame(across, ngram_join.LINK)
    common = lambda asked: spark.createDataFrame([size(r.a, r.b) for r in asked.collect()], ngram_join.LINK)
    yes, open_ = ngram_join._derived(pairs.drop("common"), ngram_join._hubs(linked), 80, common)
    yes, open_ = {tuple(r) for r in yes.collect()}, {tuple(r) for r in open_.collect()}
    assert all(similar(a, b) for a, b in yes)
    assert not any(similar(a, b) for a, b, *_ in across if (a, b) not in yes | open_)
    assert len(open_) < len(across)


@pytest.mark.parametrize("seed", range(4))
def test_parities_bound_differences(seed):
    rnd = random.Random(seed)
    for n in (1, 5, 300, 3000):
        x, y = ({rnd.randrange(2**64) for _ in range(n)} for _ in range(2))
        y = set(list(x)[: n // 2]) | set(list(y)[n // 2 :])
        sets = [np.array(sorted(s), np.uint64) for s in (x, y)]
        bits = [ngram_join.parity(s) for s in sets]
        for size in {64, min(map(len, bits))}:
            assert np.bitwise_count(ngram_join.folded(bits[0], size) ^ ngram_join.folded(bits[1], size)).sum() <= len(x ^ y)


def test_string_ids_and_clashing_columns(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [("b", text, 1, 2, 3), ("a", text + " ", 4, 5, 6), ("a", text + " ", 3, 5, 6), ("c", "other words stand here", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, _id long, _key long, _goes long")
    found = ngram_join.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.component_id) for r in found) == Counter([("b", "a"), ("a", "a"), ("a", "a"), ("c", "c")])
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [("a", text + " ", 3, 5, 6), ("c", "other words stand here", 7, 8, 9)]


def test_defined_cases(spark, texts, no_texts):
    rows = [(r.doc_id, r.text) for r in texts.collect()]
    assert Counter(map(tuple, ngram_join.near_duplicates(texts).collect())) == Counter(brute(rows))
    assert ngram_join.near_duplicates(no_texts).count() == 0
    kept = ngram_join.keep_one(texts)
    assert kept.columns == texts.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([d for d in range(12)] + [None, None])


def test_documents_of_the_smallest_data(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert Counter(map(tuple, ngram_join.near_duplicates(documents).collect())) == Counter(brute(rows))


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(9, k) for k in range(20)] + [(30, 31), (31, 32), (30, 30)]])
def test_components(spark, edges):
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert Counter(map(tuple, found)) == Counter(root.items())
