"""Golden values and invariants of the library's own operators."""

import pytest
from pyspark.sql import functions as F

from heddle.functions import arrays
from heddle.operators import budget, clean, inference, policies, splits
from heddle.sources import files, views

DATA = "/root/testdata/sf0.001"


def one(spark, pu, pa, part, label=0):
    df = spark.createDataFrame([(1, pu, pa, label, 0.2, 0.0)], "event_id long, p_user array<double>, p_assist array<double>, label int, prefix_time_s double, timestamp_s double")
    return policies.expand(df, F.array(part(policies.Staged()))).first()


def test_policies_by_hand(spark):
    # four classes: the user is sure of 2; the assistant's 3 costs 0.62 - 0.21 = 0.41 of agency
    pu, pa = [0.07, 0.10, 0.62, 0.21], [0.03, 0.04, 0.25, 0.68]
    got = {t: one(spark, pu, pa, lambda p, t=t: policies.set_budget(p, t)) for t in (0.40, 0.42)}
    assert [got[t].selected_action for t in got] == [2, 3] and [got[t].source for t in got] == ["user", "agency_set"]
    assert abs(got[0.42].expected_ali - 0.41) < 1e-12 and abs(got[0.42].margin - 0.01) < 1e-12
    # equal utilities within the budget: the one that leaves more of it, then the lower class
    r = one(spark, [0.30, 0.28, 0.26, 0.16], [0.02, 0.35, 0.35, 0.28], lambda p: policies.margin_budget(p, 0.05))
    assert r.selected_action == 1 and r.probs[3] == 0 and abs(sum(r.probs) - 1) < 1e-12
    r = one(spark, [0.31, 0.23, 0.23, 0.23], [0.04, 0.32, 0.32, 0.32], lambda p: policies.margin_budget(p, 0.10))
    assert r.selected_action == 1 and r.coverage == 0.32
    # nothing within the budget is likelier than the user's own: the user's vector
    r = one(spark, [0.55, 0.25, 0.20], [0.50, 0.30, 0.20], lambda p: policies.margin_budget(p, 0.35))
    assert (r.selected_action, r.source, r.probs) == (0, "user", [0.55, 0.25, 0.20])
    # ties of the user go to the first class
    assert one(spark, [0.4, 0.4, 0.2], [0.1, 0.2, 0.7], policies.user_only).selected_action == 0
    r = one(spark, [0.2, 0.6, 0.2], [0.6, 0.2, 0.2], lambda p: policies.blend(p, 0.5), label=1)
    assert r.selected_action == 0 and not r.correct and abs(r.coverage - 0.4) < 1e-12


def test_masked_vector_is_lifted_to_its_action(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.3], [0, 1, 2], 2)], "p array<double>, ok array<int>, x int")
    (q,) = df.select(policies.masked_probs(F.col("p"), F.col("ok"), F.col("x"))).first()
    assert max(range(3), key=q.__getitem__) == 2 and abs(sum(q) - 1) < 1e-12 and q[0] < q[1] < q[2]


def test_exact_sign_flips_of_large_groups(spark):
    df = spark.range(20).select((F.col("id") >= 15).cast("int").alias("g"), (F.col("id") % 4 + 0.5).alias("v"))
    got = {r.g: r.p_value for r in inference.exact_signflip_p(df, "v", ["g"]).collect()}
    assert got[1] == 2 / 2**5 and 0 < got[0] < 0.01


def test_arrays(spark):
    row = spark.range(1).select(
        arrays.argmax(F.array(*map(F.lit, (0.4, 0.4, 0.2)))).alias("tie"),
        arrays.pad_left(F.array(F.lit(1.0), F.lit(2.0)), 3).alias("left"),
        arrays.pad_left(F.array(F.lit(1.0), F.lit(2.0)), 1).alias("cut"),
        arrays.at_temperature(F.array(F.lit(0.8), F.lit(0.2)), 1.0).alias("same"),
        arrays.one_hot(F.lit(0.4), [0.2, 0.4]).alias("hot"),
    ).first()
    assert (row.tie, row.left, row.cut, row.hot) == (0, [0.0, 1.0, 2.0], [2.0], [0.0, 1.0])
    assert abs(row.same[0] - 0.8) < 1e-9


def test_interpolated_curve(spark):
    curve = spark.createDataFrame([(1, 0.4, 0.5), (1, 0.6, 0.7), (1, 0.6, 0.9)], "unit int, budget double, value double")
    targets = spark.createDataFrame([(1, 0.5), (1, 0.75), (2, 0.5)], "unit int, target double")
    got = {(r.unit, r.target): r for r in budget.interpolate_curve(curve, targets, ["unit"]).collect()}
    assert abs(got[1, 0.5].value - 0.65) < 1e-12 and got[1, 0.5].n_points == 2 and abs(got[1, 0.5].nearest_gap - 0.1) < 1e-12
    assert got[1, 0.75].value is None and not got[1, 0.75].supported and got[1, 0.75].extrapolated
    assert got[2, 0.5].n_points == 0 and not got[2, 0.5].supported


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.001), ("a", 0.02), ("a", 0.5), ("b", 0.04)], "g string, p double")
    rows = inference.holm_annotate(df, ["g"], "p", []).orderBy("g", "p").collect()
    assert [r.holm_reject for r in rows] == [True, True, False, True] and [r.n_tests for r in rows] == [3, 3, 3, 1]


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(40).select(F.lit(1).alias("g"), (F.col("id") % 7 / 7.0).alias("v"))
    a, b = (inference.bootstrap_ci(df.repartition(n), "v", ["g"], 400).first() for n in (1, 5))
    assert (a.ci_low, a.ci_high) == (b.ci_low, b.ci_high) and a.ci_low < a.estimate < a.ci_high
    assert inference.signflip_p(df.limit(1), "v", ["g"], 50).first().p_value == 1.0


def test_incomplete_pairs_raise(spark):
    u = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2), (2, "a", 0.3)], "unit int, policy string, m double")
    with pytest.raises(Exception, match="incomplete pair"):
        inference.paired_matrix(u, ["unit"], "a", "b", "m").collect()


def test_errors(spark):
    df = spark.createDataFrame([(1, "x")], "row_id int, k string")
    with pytest.raises(ValueError):
        clean.apply_exclusions(df, spark.createDataFrame([("nowhere",)], "k string"), "k")
    with pytest.raises(ValueError):
        splits.splits_for(df, "unheard of")
    with pytest.raises(KeyError):
        splits.leakage(df.withColumn("split_id", F.lit("s")), df, ["absent"])
    with pytest.raises(ValueError):
        files.require_columns(df, ("absent",))


def test_folds_are_disjoint_and_leak_free(spark):
    m = views.metadata(spark, DATA)
    f = splits.group_k_fold(m, "subject_id", 4)
    assert splits.leakage(f, m, ["subject_id"]).count() == 0
    assert f.where("role = 'test'").groupBy("row_id").count().where("count <> 1").count() == 0


def test_reports_round_trip(spark, tmp_path):
    t = views.traces(spark, DATA).limit(20).drop("step")
    files.write_report(t, str(tmp_path / "t.csv"), "csv")
    back = files.read_traces(spark, str(tmp_path / "t.csv"))
    assert back.count() == 20 and dict(back.dtypes)["p_user"] == "array<double>"
    inv = files.file_inventory(spark, str(tmp_path))
    assert inv.count() > 0 and inv.where("length(sha256) <> 64").count() == 0
    assert {r.check: r.passed for r in files.inventory_checks(inv, [("csv", F.max((F.col("extension") == ".csv").cast("int")) == 1), ("none", F.count(F.lit(1)) == 0)]).collect()} == {"csv": True, "none": False}
    assert files.output_manifest(spark, str(tmp_path)).where("extension = '.csv'").agg(F.sum("rows")).first()[0] >= 20 - 1


def test_stream_of_decisions(spark, tmp_path):
    from heddle.streaming.decisions import stream_decisions

    t = views.base_traces(spark, DATA).select("event_id", "p_user", "p_assist", "label", "prefix_time_s", "timestamp_s").limit(50)
    t.write.parquet(str(tmp_path / "in"))
    s = stream_decisions(spark.readStream.schema(t.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("decided").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("decided").count() == policies.policy_grid(t).count()


def test_entry_point_imports_and_runs(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_estimators_have_the_sizes_of_the_reference(spark):
    from heddle.operators import scoring

    assert scoring.estimator("forest", 64, 10).getNumTrees() == 512
    assert list(scoring.estimator("mlp", 64, 10).getLayers()) == [64, 512, 256, 10]
    assert scoring.estimator("logistic", 64, 10).getMaxIter() == 2000
