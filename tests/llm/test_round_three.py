"""Spelling variants, conversation trie and byte-level BPE against brute force and the library."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from heddle.llm import byte_bpe, conversation_trie, spelling_variants

PATH = public_tokenizers.path("byte_bpe_50k.json")


# spelling variants


def brute_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = regex.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    cut = defaultdict(set)
    for w in kept:
        for i in range(len(w)):
            cut[w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for (head, tail), words in cut.items():
        for w in words:
            near[w] |= words - {w}
            if head + tail in kept:
                near[w].add(head + tail)
                near[head + tail].add(w)
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-kept[v], v))
            if kept[best] >= 5 * kept[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), kept.get(form.get(w))) for w, n in kept.items()}


def variants(docs):
    return [tuple(r) for r in spelling_variants.group_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_variants_of_documents(documents):
    got = variants(documents)
    want = brute_variants([tuple(r) for r in documents.select("doc_id", "text").collect()])
    assert len(got) == len(want) and set(got) == want


def test_variants_planted(spark):
    r = random.Random(5)
    rows = []
    for k in range(700):
        w = r.choice(["colour", "color", "colours", "aabbaa", "aaabbaa", "aabbaaa", "ßéàôüÿ", "ßéàôüÿÿ", "banana", "bananaa", "bandana"])
        rows.append((k, " ".join([w] * r.choice([1, 1, 5, 30]) + ["colour"] * 20 + ["x" * 3000] + (["x" * 2999] if k % 40 == 0 else []))))
    # a chain of forms: each six times as frequent as the one before
    for k, n in enumerate([5, 30, 180, 1080, 6480]):
        rows.append((1000 + k, ("chain" + "abcde"[: k + 1] + " ") * n))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = variants(df)
    want = brute_variants(rows)
    assert len(got) == len(want) and set(got) == want
    by = {x[0]: x for x in got}
    assert by["chaina"][2] == "chainabcde" and by["x" * 2999][1] == "x" * 3000


def test_variants_odd_rows(spark, texts, no_texts):
    want = brute_variants([tuple(r) for r in texts.select("doc_id", "text").collect()])
    got = variants(texts.withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("key", F.lit(1)))
    assert set(got) == want and len(got) == len(want)
    assert variants(no_texts) == []
    assert variants(texts.where("text is null")) == []
    with pytest.raises(ValueError, match="ratio"):
        spelling_variants.group_variants(texts, ratio=1)


def test_nodes_over_many_ranges(spark):
    """The same prefix has one number wherever its words were dealt, and different prefixes have different ones."""
    r = random.Random(2)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(600)} | {"pre" * 20 + x for x in "abcdefghij"})
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(3)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = spelling_variants.number_nodes(df, F.col("word"), "nodes").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    number, prefix = {}, {}
    for row in rows:
        assert len(row.nodes) == len(row.word) + 1
        for k, node in enumerate(row.nodes):
            assert number.setdefault(row.word[:k], node) == node and prefix.setdefault(node, row.word[:k]) == row.word[:k]
    assert [r.word for r in sorted(rows, key=lambda r: r.nodes[-1])] == words


# conversation trie


def brute_trie(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    out = set()
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(k))
        out.add((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie(df):
    return [tuple(r) for r in conversation_trie.prefix_trie(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]


def test_trie_of_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got, want = trie(df), brute_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert len(got) == len(want) and set(got) == want


def test_trie_deep_tied_and_null(spark):
    r = random.Random(3)
    rows = [(None, 1, "a", "b"), (None, None, None, None)]
    for c in [*range(40), 100, 103, 1_000_000]:
        for k in range(r.choice([1, 2, 9, 12, 20, 70, 150 if c == 10 else 3])):
            if c % 2:
                rows.append((c, r.choice([k, None, 3]), r.choice(["u", "a", None]), r.choice(["x", "yé", None, "long " * 500])))
            else:
                rows.append((c, k, "u", r.choice("ab")))
    rows += rows[:10]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    clash = df.withColumn("depth", F.lit(1)).withColumn("k1", F.lit(1)).withColumn("part", F.lit("x")).withColumn("pos", F.lit(0))
    got, want = trie(clash), brute_trie(rows)
    assert len(got) == len(want) and set(got) == want


def test_trie_of_nothing_and_of_no_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie(spark.createDataFrame([], schema)) == []
    assert trie(spark.createDataFrame([(None, 1, "a", "b")], schema)) == []
    rows = [(c, 0, None, None) for c in range(1, 5)]
    assert set(trie(spark.createDataFrame(rows, schema))) == brute_trie(rows)


def test_one_conversation_over_many_tasks(spark):
    """A conversation of most rows, equal conversations, and ends in chunks."""
    rows = [(5, k, "u", f"t{k}") for k in range(700)] + [(c, 0, "u", "same") for c in range(1000, 1400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    chunk, conversation_trie.CHUNK = conversation_trie.CHUNK, 7
    try:
        got = trie(df)
    finally:
        conversation_trie.CHUNK = chunk
    want = brute_trie(rows)
    assert len(got) == len(want) and set(got) == want


# byte-level BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_bpe_equals_the_library(documents, texts, library):
    for df in (documents, texts):
        rows = df.select("doc_id", "text").collect()
        got = byte_bpe.digests(df.withColumn("ids", F.lit(1)), PATH).collect()
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == Counter((r.doc_id, *expected(library, r.text)) for r in rows)


def test_bpe_round_trip(documents, texts, no_texts, library):
    assert byte_bpe.digests(no_texts, PATH).count() == 0
    found = byte_bpe.encode(texts, PATH)
    want = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids)) for r in texts.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in found.collect()) == want
    back = Counter((r.doc_id, r.text) for r in byte_bpe.decode(byte_bpe.encode(documents, PATH), PATH).collect())
    assert back == Counter((r.doc_id, r.text or "") for r in documents.collect())


def test_bpe_of_random_strings(library):
    codec, r = byte_bpe.Codec(PATH), random.Random(1)
    letters = "ab \n\t'srevlldm　\xa0\x85 é1½²,.🙂\x1c\x00​Å"
    for k in range(3000):
        s = "".join(r.choice(letters) for _ in range(r.randrange(30))) + r.choice(["", "<|endoftext|>", "'s", "  "]) + "".join(r.choice(letters) for _ in range(r.randrange(10)))
        ids = library.encode(s, add_special_tokens=False).ids
        assert codec.encode(s) == ids, repr(s)
        cut = [x for x in ids if r.random() < 0.8]  # half characters too
        assert codec.decode(cut) == library.decode(cut, skip_special_tokens=False)


def test_bpe_splits_at_every_code_point_as_the_library_does(library):
    codec = byte_bpe.Codec(PATH)
    for cp in [*range(1, 0x3100), 0xFEFF, 0xFFFD, *range(0x3100, 0x110000, 4999)]:
        if not 0xD800 <= cp < 0xE000:
            s = f"ab{chr(cp)}cd {chr(cp)}x  {chr(cp)}{chr(cp)} y"
            assert codec.encode(s) == library.encode(s, add_special_tokens=False).ids, hex(cp)


def test_bpe_steps_of_long_texts(monkeypatch, library):
    text = "some words, 'and' others   \n\n <|endoftext|> x" * 50 + "y" * 20_000
    monkeypatch.setattr(byte_bpe, "_STEP", 37)
    codec = byte_bpe.Codec(PATH)
    assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert codec.digest(text) == expected(library, text)


def test_merge_order():
    """Lowest rank first, leftmost of equals; what a merge makes stale is skipped."""
    codec = byte_bpe.Codec(PATH)
    a, b, c = 1, 2, 3
    codec.merges = {b << 20 | c: 0 << 20 | 4, a << 20 | b: 1 << 20 | 5, a << 20 | a: 2 << 20 | 6, 4 << 20 | 4: 3 << 20 | 7}
    assert codec.merge([a, b, c]) == [a, 4]
    assert codec.merge([a, a, a]) == [6, a]
    assert codec.merge([a, b, b, c, b, c]) == [5, 7]
    assert codec.merge([]) == [] and codec.merge([a]) == [a]
