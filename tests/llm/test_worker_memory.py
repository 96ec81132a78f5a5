"""What the corpus operators leave in an executor's Python workers."""

from heddle.llm import common, kneser_ney, quality_rules
from heddle.llm.common import local_rows


def test_few_rows_reach_the_jvm_without_python_workers(spark):
    rows = [(1, "a", None), (None, "ü", 2.5)]
    got = local_rows(spark, rows, "id long, name string, x double")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    assert local_rows(spark, [], got.schema).collect() == [] and local_rows(spark, [], got.schema).schema == got.schema
    assert "ExistingRDD" not in got._jdf.queryExecution().toString()


def test_training_sample_of_the_classifier_needs_no_python_rows(spark):
    docs = spark.sql("SELECT id AS doc_id, concat('some words ', id) AS text, 'en' AS lang FROM range(40)")
    labels = spark.sql("SELECT id AS doc_id, 1 AS quality, 0 AS toxic FROM range(40)")
    train, held = kneser_ney.Classifier(max_docs=5).samples(docs, labels)
    assert train.count() == 5 and held.count() == 35
    for df in (train, held):
        assert "ExistingRDD" not in df._jdf.queryExecution().toString()


def test_rules_empty_other_operators_caches_before_they_measure(spark, monkeypatch):
    docs = spark.sql("SELECT concat('a few words ', id) AS text FROM range(20)")
    functions, kind = [], type(docs)
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, f0=kind.mapInArrow, **b: functions.append(f) or f0(self, f, *a, **b))
    quality_rules.estimate(docs)
    kept = {"a": 1}
    monkeypatch.setattr(common, "_caches", {"another": kept.clear})
    monkeypatch.setattr(common, "_owner", "another")
    list(functions[0](iter([])))
    assert kept == {} and common._owner == quality_rules.__name__
