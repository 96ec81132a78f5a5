import sys
from collections import Counter

import corpus_pipeline
from heddle.llm import kneser_ney, packing, quality_rules
from test_ngram_join import brute
from test_text_operators import WORD, direct_ids

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, documents):
    docs, kept = documents, None
    found = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, DATA)
        after = docs.collect()
        found.append(name)
        if name != "packing":
            assert docs.columns == documents.columns
            assert not Counter(map(str, after)) - Counter(map(str, before))
        if name == "quality_rules":
            texts = {r.doc_id: quality_rules.Text(r.text.encode()) for r in before}
            kept = {d for d, t in texts.items() if not t.base_failed and not any(r.rejects(t) for r in quality_rules.RULES)}
        if name == "quality_classifier":
            judged = kneser_ney.Classifier().judge(spark.createDataFrame(before, documents.schema), spark.read.parquet(f"{DATA}/labels.parquet"))
            kept = {r.doc_id for r in judged.collect() if r.kept}
        if name == "ngram_jaccard_join":
            kept = {d for d, _, c in brute([(r.doc_id, r.text) for r in before]) if d == c}
        if name == "packing":
            expected = Counter()
            for r, ids in zip(before, direct_ids([r.text for r in before]), strict=True):
                at = 0
                for n in packing.cuts(len(ids) + 1, 4096):
                    expected[r.doc_id, at, n] += 1
                    at += n
            assert Counter((r.doc_id, r.start, r.length) for r in after) == expected
        else:
            assert Counter(r.doc_id for r in after) == Counter(kept)
            docs = spark.createDataFrame(after, documents.schema)
    assert found == ["quality_rules", "quality_classifier", "ngram_jaccard_join", "packing"]


def test_run_equals_the_stages(spark, documents):
    rows = corpus_pipeline.run(spark, DATA).count()
    docs = documents
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == rows > 0


def test_stages_take_odd_rows(spark, texts, no_texts):
    for docs in (texts, no_texts):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns
            assert not Counter(map(str, out.collect())) - Counter(map(str, docs.collect()))
        found = Counter()
        for r in corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect():
            found[r.doc_id] += r.length
        expected = Counter()
        rows = docs.collect()
        for r, ids in zip(rows, direct_ids([r.text for r in rows]) if rows else [], strict=True):
            expected[r.doc_id] += len(ids) + 1
        assert found == expected
    assert WORD and sys.modules["corpus_pipeline"]
