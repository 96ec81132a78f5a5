import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from heddle.llm import common, kneser_ney, maxent_lm
from heddle.llm.common import hash_words, mix, text_words
from heddle.llm.queries import op3_kneser_ney

SPACES = {ord(c): " " for c in "\t\n\x0b\x0c\r"}


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in lower.translate(SPACES).split(" ") if w]


# maximum entropy


def brute(rows):
    train = lambda d: d is None or zlib.crc32(str(d).encode()) % 5 != 1
    count = Counter()
    for d, t in rows:
        if train(d):
            count.update([*words(t), None])
    total, distinct = sum(count.values()), len(count)
    out = []
    for d, t in rows:
        own = [*words(t), None]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        out.append((d, not train(d), len(own), sum(count[w] > 0 for w in own), total, base))
    return out


def close(found, expected):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    found, expected = sorted((tuple(r)[:6] for r in found), key=order), sorted(expected, key=order)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    assert np.allclose([r[5] for r in found], [r[5] for r in expected], rtol=1e-12)


@pytest.mark.parametrize("name", ["texts", "documents", "no_texts"])
def test_base_scores(request, name, monkeypatch):
    monkeypatch.setattr(maxent_lm, "HEAD", 50)
    monkeypatch.setattr(maxent_lm, "SHARD_WORDS", 1000)
    monkeypatch.setattr(maxent_lm, "ASKED", 500)
    docs = request.getfixturevalue(name)
    found = maxent_lm.score_documents(docs, steps=2).collect()
    close(found, brute([(r.doc_id, r.text) for r in docs.collect()]))
    assert all(r.score <= 1e-9 for r in found)


def test_no_training_documents(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    (r,) = maxent_lm.score_documents(spark.createDataFrame([(held, "a b c")], "doc_id long, text string")).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 4, 0, 0, 0.0)
    assert abs(r.score - 4 * math.log10(1 / maxent_lm.CLASSES / maxent_lm.GROUPS)) < 1e-5


def test_held_out_texts_are_likelier_than_by_the_base_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in maxent_lm.score_documents(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.05 * sum(r.n_tokens for r in rows)


def test_probabilities_sum_to_one_and_training_raises_likelihood(spark, documents):
    own = documents.selectExpr("doc_id", "cast(text as binary) as text")
    counts = maxent_lm.word_counts(own).persist()
    model = maxent_lm.fit(own, counts)
    h, sizes = maxent_lm.tokens([bytes(r.text) for r in own.collect() if r.text is not None])
    k = model.groups.of(h)
    assert all(np.allclose(p.sum(axis=1), 1, atol=1e-5) for *_, p in maxent_lm.factors(model.weights, model.bias, h, sizes, k))
    assert np.isclose(sum(np.exp(b).sum() for b in model.bias), 1 + maxent_lm.CLASSES)
    level = lambda w: maxent_lm.log_probabilities(w, model.bias, h, sizes, k).mean()
    assert level(model.weights) > level(np.zeros_like(model.weights)) + 0.1


FULL = (1 << 64) - 1


def finished(h):
    for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ h >> 33) * k & FULL
    return h ^ h >> 33


def brute_softmax(parts, tests, bits):
    """Scores of tests by a model of dictionaries, trained on parts (lists of texts), one update from each."""
    m = maxent_lm
    end, a, b, c, d = int(m._END), *map(int, m._MIX)
    number = lambda w: end if w is None else xxhash.xxh3_64_intdigest(w.encode())
    own = lambda t: [*map(number, words(t)), end]
    count = Counter(h for p in parts for t in p for h in own(t))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    frequent = sorted(count, key=lambda h: (-count[h], signed(h)))
    ids = {h: k for k, h in enumerate([end, *(h for h in frequent[: m.OWN] if h != end)][: m.OWN])}
    group = lambda h: ids.get(h, m.OWN + h % (m.CLASSES * m.GROUPS - m.OWN))
    mass, kinds = Counter(), Counter(map(group, count))
    for h, n in count.items():
        mass[group(h)] += n
    by_class = [sum(mass[k * m.GROUPS + j] for j in range(m.GROUPS)) for k in range(m.CLASSES)]
    prior = [math.log((n + 0.5) / (sum(by_class) + 0.5 * m.CLASSES)) for n in by_class]
    inner = [[math.log((mass[k * m.GROUPS + j] + 0.5) / (by_class[k] + 0.5 * m.GROUPS)) for j in range(m.GROUPS)] for k in range(m.CLASSES)]
    weights = defaultdict(lambda: [0.0] * m.GROUPS)

    def choices(text):
        """Of each token: its hash, and (rows, bias, outcome) of both factors."""
        one = two = end
        for h in own(text):
            x = [finished(one * a & FULL), finished(two * b & FULL), finished(one * c + two * d & FULL)]
            k, j = divmod(group(h), m.GROUPS)
            second = [((f ^ (k + 1) * b & FULL) * a & FULL) >> 64 - bits for f in x]
            yield h, [([(0, f >> 64 - bits) for f in x], prior, k), ([(1, f) for f in second], inner[k], j)]
            one, two = h, one

    def chances(rows, bias):
        s = [math.exp(x + sum(weights[r][j] for r in rows)) for j, x in enumerate(bias)]
        return [x / sum(s) for x in s]

    for part in parts:
        seen, expected = (defaultdict(lambda: [0.0] * m.GROUPS) for _ in "ab")
        for t in part:
            for _, both in choices(t):
                for rows, bias, outcome in both:
                    p = chances(rows, bias)
                    for r in rows:
                        seen[r][outcome] += 1
                        expected[r] = [x + y for x, y in zip(expected[r], p, strict=True)]
        for r, e in expected.items():
            weights[r] = [w + 0.5 * math.log((o + 4) / (x + 4)) for w, o, x in zip(weights[r], seen[r], e, strict=True)]
    out = []
    for t in tests:
        total = 0.0
        for h, both in choices(t):
            total += sum(math.log10(chances(rows, bias)[k]) for rows, bias, k in both)
            total += math.log10((count[h] + 0.5) / (mass[group(h)] + 0.5 * (kinds[group(h)] + 1)))
        out.append(total)
    return out


def test_scores_equal_a_model_of_dictionaries(spark):
    rng = np.random.default_rng(3)
    line = lambda: " ".join(f"w{int(k)}" for k in rng.zipf(1.3, 25) % 900)
    rows = [(k, None if k == 7 else "" if k == 8 else f"A b\tC {line()}") for k in range(120)] + [(None, "a b c"), (5, "a b c"), (5, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dealt = docs.selectExpr("doc_id", "text", "pmod(xxhash64(doc_id, cast(text AS binary)), 4) AS part").collect()
    train = [r for r in dealt if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
    parts = [[r.text for r in train if r.part == k] for k in range(4)]
    found = maxent_lm.score_documents(docs).collect()
    order = lambda x: sorted(x, key=lambda r: (r[0] is None, r[0], r[1]))
    expected = brute_softmax(parts, [r.text for r in dealt], maxent_lm.LEAST_BITS)
    got = order((r.doc_id, r.score) for r in found)
    want = order(zip([r.doc_id for r in dealt], expected, strict=True))
    assert [r[0] for r in got] == [r[0] for r in want]
    assert np.allclose([r[1] for r in got], [r[1] for r in want], rtol=1e-4)


# Kneser-Ney


def brute_model(texts):
    tri = Counter()
    for t in texts:
        own = ["<s>", "<s>", *words(t), "</s>"]
        tri.update(zip(own, own[1:], own[2:]))
    bi = Counter()
    for (u, v, w), c in tri.items():
        bi[v, w] += c if v == "<s>" else 1
    uni = Counter(w for _, w in bi)

    def rates(counts):
        n = [sum(c == k for c in counts.values()) for k in range(5)]
        if not n[1] or not n[2]:
            return 0.5, 0.75, 0.9
        y = n[1] / (n[1] + 2 * n[2])
        raw = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5)
        return tuple(min(max(d, 0.1), k - 0.1) for k, d in enumerate(raw, 1))

    d3, d2, d1 = rates(tri), rates(bi), rates(uni)
    cut = lambda c, d: d[min(c, 3) - 1]
    sums = {n: (defaultdict(int), defaultdict(float)) for n in (2, 3)}
    for n, counts, d in ((3, tri, d3), (2, bi, d2)):
        for g, c in counts.items():
            sums[n][0][g[:-1]] += c
            sums[n][1][g[:-1]] += cut(c, d)
    total, freed = sum(uni.values()), sum(cut(c, d1) for c in uni.values())
    unknown = freed / total / (len(uni) + 1)

    def p(u, v, w):
        out = ((uni[w] - cut(uni[w], d1)) / total if w in uni else 0) + unknown
        for n, counts, d, g in ((2, bi, d2, (v, w)), (3, tri, d3, (u, v, w))):
            t, f = sums[n][0].get(g[:-1]), sums[n][1].get(g[:-1])
            if t:
                out = (counts[g] - cut(counts[g], d) if g in counts else 0) / t + f / t * out
        return out

    return p, uni


TRAIN = ["a b c d a b c", "a b d", "b c a b c", "x y z a b", "a a a b b", "c c d d a b c d", ""]


def test_model_equals_brute_force_and_sums_to_one(spark):
    docs = spark.createDataFrame([(t,) for t in TRAIN], "text string")
    table, unknown = kneser_ney.load(spark, kneser_ney.train(docs))
    p, uni = brute_model(TRAIN)
    tests = ["a b c d", "d c b a q q a b", "A B", "", None, "x y z a b c"]
    logs, sizes = kneser_ney.token_logs(table, unknown, [None if t is None else t.encode() for t in tests])
    expected = [math.log10(p(*g)) for t in tests for own in [["<s>", "<s>", *words(t), "</s>"]] for g in zip(own, own[1:], own[2:])]
    assert sizes.tolist() == [len(words(t)) + 1 for t in tests]
    assert np.allclose(logs, expected, rtol=1e-5)
    for u, v in (("a", "b"), ("q", "a"), ("<s>", "<s>"), ("q", "q")):
        assert abs(sum(p(u, v, w) for w in uni) + p(u, v, "never seen") - 1) < 1e-9


def test_classifier_keeps_clean_documents_and_rejects_junk(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = op3_kneser_ney(spark, d).join(labels, "doc_id").collect()
    share = lambda q: np.mean([r.kept for r in rows if r.quality == q])
    assert share(1) > 0.95 and share(0) < 0.1
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    for lang in set(docs.values()):
        bad = [r.kept for r in rows if r.quality == 0 and docs[r.doc_id] == lang]
        assert sum(bad) <= max(1, 0.2 * len(bad)), (lang, bad)


def test_classifier_defined_cases(spark, texts, no_texts):
    labels = spark.createDataFrame([(3, 1, 0), (5, 1, 0), (10, 1, None), (9, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = kneser_ney.Classifier(max_docs=2).judge(texts, labels)
    assert Counter((r.doc_id, r.n_tokens) for r in found.collect()) == Counter((r.doc_id, len(words(r.text)) + 1) for r in texts.collect())
    assert kneser_ney.Classifier().judge(no_texts, labels).count() == 0
    assert all(r.kept for r in kneser_ney.Classifier().judge(texts, labels.limit(0)).collect())


def test_limits_cover_all_trusted_documents(spark):
    """A rare language has its own limit, however many trusted documents come before its own by hash."""
    ids = spark.range(25_000).selectExpr("id", "xxhash64(id, 'trusted') AS r", "pmod(xxhash64(id, 'half'), 2) AS half").orderBy("r").collect()
    rare = [x.id for x in ids[20_000:] if x.half == 1][:3]
    text = " ".join(f"strange{k}" for k in range(40))
    docs = spark.range(25_000).selectExpr("id AS doc_id", f"CASE WHEN id IN {tuple(rare)} THEN 'xx' ELSE 'en' END AS lang", f"CASE WHEN id IN {tuple(rare)} THEN '{text}' ELSE 'a b c' END AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    found = kneser_ney.Classifier(max_docs=50).judge(docs, labels).where("lang = 'xx'").collect()
    assert len(found) == 3 and all(r.kept and r.level * 1.09 < r.limit < r.level * 1.11 for r in found)


def test_an_overlong_document_is_passed_over(spark):
    ids = spark.range(40).selectExpr("id", "pmod(xxhash64(id, 'half'), 2) AS half").orderBy(F.expr("xxhash64(id, 'trusted')")).collect()
    long = next(x.id for x in ids if x.half == 0)
    docs = spark.range(40).selectExpr("id AS doc_id", "'en' AS lang", f"CASE WHEN id = {long} THEN repeat('a ', 1000) ELSE 'a b c' END AS text")
    own, _ = kneser_ney.Classifier(max_words=100).samples(docs, docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic"))
    assert {r.doc_id for r in own.collect()} == {x.id for x in ids if x.half == 0} - {long}


def test_lookup_shards():
    from heddle.llm.hash_table import Shard

    keys = mix(np.arange(5000, dtype=np.uint64))
    s = Shard(keys[:4000], np.arange(4000))
    assert s.get(keys[3000:5000], -1).tolist() == list(range(3000, 4000)) + [-1] * 1000
    assert Shard(keys[:0], np.zeros(0, np.int64)).get(keys[:3], 7).tolist() == [7, 7, 7]
    assert len(set(hash_words([b"a", b"b", b"a"]).tolist())) == 2


def test_words_of_texts_are_hashed_at_once_as_one_by_one():
    words_of = lambda t: (t or b"").lower().split()
    texts = [None, b"", b" \t", b"A\x0bb \xff\xc3\xa9\x00 \x85\xa0", *[b"%s Zz" % (bytes(range(40, 127)) * 2)[:k] for k in range(170)], b"Q" * 3_000_000, b"end"]
    h, sizes = text_words(texts)
    assert sizes.tolist() == [len(words_of(t)) for t in texts]
    assert (h == hash_words([w for t in texts for w in words_of(t)])).all()
    assert [len(x) for x in text_words([])] == [0, 0]


def test_hashing_the_tokens_of_a_text_keeps_no_object_for_each_word():
    common._words.clear()
    text = b" ".join(b"w%d" % k for k in range(5000))
    maxent_lm.tokens([text])
    kneser_ney.grams([text])
    assert not common._words and not hasattr(maxent_lm, "_words")


def test_rows_that_repeat_are_added_in_place():
    total, rows = np.zeros((8, maxent_lm.CLASSES), np.float32), np.array([3, 1, 3, 3, 7])
    values = np.arange(5 * maxent_lm.CLASSES, dtype=np.float32).reshape(5, -1)
    want = np.zeros_like(total)
    for r, x in zip(rows, values, strict=True):
        want[r] += x
    maxent_lm.add_rows(total, rows, values)
    assert (total == want).all()
