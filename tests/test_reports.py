"""Report gates, manifests, stress levels and temperatures against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from heddle.operators import inference, reports, scoring, signal, splits
from heddle.sources import files


def test_temperature_is_the_best_of_a_dense_grid(spark):
    rows = [(g, [0.05 + 0.9 * ((7 * i + g) % 10) / 10, 0.95 - 0.9 * ((7 * i + g) % 10) / 10], int((i * i + g) % 7 < 3)) for g in range(3) for i in range(40)]
    rows += [(3, [0.2, 0.8], 1), (3, [0.1, 0.9], 1), (4, [0.1, 0.9], 1), (4, [0.1, 0.9], 0)]
    df = spark.createDataFrame(rows, "g int, p_assist array<double>, label int")
    got = {r.g: r.temperature for r in scoring.fit_temperature(df, ["g"]).collect()}

    def loss(g, t):
        own = [(p, y) for h, p, y in rows if h == g]
        return sum(math.log(sum(math.exp((math.log(x) - math.log(p[y])) / t) for x in p)) for p, y in own) / len(own)

    for g in range(3):
        best = min(loss(g, 0.25 + k * 7.75 / 5000) for k in range(5001))
        assert loss(g, got[g]) <= best + 1e-9
    assert got[3] == 1.0  # one class
    assert abs(got[4] - 8.0) < 1e-9  # equal chances: as flat as the bounds allow


def test_losses_added_up_in_tasks_equal_the_columns(spark):
    from heddle.functions.arrays import at_temperature
    from heddle.operators import metrics

    rows = [(f"g{i % 3}", [0.0, 1.0] if i % 5 == 0 else [0.1 * (i % 7), 0.3, 1e-14], i % 2) for i in range(40)] + [("g0", None, 1), ("g1", [0.5, 0.5], None), ("g4", None, 0)]
    df = spark.createDataFrame(rows, "g string, p_assist array<double>, label int")
    ts = [0.25, 1.0, 8.0]
    want = {(r.g, t): r.loss for t in ts for r in df.groupBy("g").agg(F.avg(metrics.nll(at_temperature(F.col("p_assist"), t), F.col("label"))).alias("loss")).collect() if r.loss is not None}
    got = {(r.g, r.t): r.loss for r in scoring.temperature_losses(df, ["g"], ts).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
    own = scoring.losses_at(df, spark.createDataFrame([(f"g{k}", t) for k, t in enumerate(ts)], "g string, temperature double"), ["g"])
    assert {r.g: round(r.loss, 12) for r in own.collect()} == {f"g{k}": round(want[f"g{k}", t], 12) for k, t in enumerate(ts)}
    with pytest.raises(Exception, match="beyond"):
        scoring.temperature_losses(df.withColumn("label", F.lit(5)), ["g"], ts).collect()


def test_manifest_rules(spark):
    good = ("d", "root", "u", "a", 3, 4, 100, ["x", "y"])
    schema = "dataset string, prepared_root string, user_model string, assist_model string, trace_count long, decision_count long, pairwise_repeats long, split_families array<string>"
    bad = ("e", " ", None, "a", 3, 2, 0, ["x", "x"])
    got = sorted(r.rule for r in reports.manifest_violations(spark.createDataFrame([good, bad], schema), "publication").collect())
    assert got == ["fewer decisions than traces", "pairwise_repeats is below 1", "prepared_root is blank", "split_families repeat", "user_model is blank"]
    prepared = "dataset string, prepared_root string, success_file string, required_files array<string>, metadata_columns array<string>, n_rows long, label_vocab_size long, user_feature_shape array<long>, assist_feature_shape array<long>, has_sequence_payloads boolean, sequence_payload_keys array<string>"
    rows = [("d", "r", "x/_SUCCESS", ["f"], ["m"], 5, 2, [5, 3], [5, 4], False, []), ("e", "r", "x", ["f"], [], 5, 2, [4, 3], [5], True, [])]
    got = sorted(r.rule for r in reports.manifest_violations(spark.createDataFrame(rows, prepared), "prepared").collect())
    assert got == ["assist_feature_shape has not two sizes", "has_sequence_payloads differs from the keys", "metadata_columns is empty", "success_file is no marker", "user_feature_shape has other rows"]
    benchmark = "dataset string, prepared_root string, user_model string, assist_model string, prepared_success_file string, assist_context_modes array<string>, split_family_allowlist array<string>, split_id_allowlist array<string>, available_sequence_payload_roles array<string>, sequence_payload_sources map<string,string>, max_splits_per_family long, n_rows long"
    rows = [("d", "r", "u", "a", "_SUCCESS", [], [], [], ["k"], {"k": "v"}, None, 0), ("e", "r", "u", "a", "_SUCCESS", [], [" "], [], ["k"], {"j": "v"}, 0, -1)]
    got = sorted(r.rule for r in reports.manifest_violations(spark.createDataFrame(rows, benchmark), "benchmark").collect())
    assert got == ["max_splits_per_family is below 1", "n_rows is below 0", "sources differ from roles", "split_family_allowlist holds a blank"]
    with pytest.raises(ValueError):
        reports.manifest_violations(spark.createDataFrame([good], schema), "unheard of")


def test_candidates_from_units_to_summary(spark):
    rows = []
    for family in ("f", "g"):
        for s in range(12):
            for tau, gain in (("0.05", 0.3), ("0.10", 0.3 if family == "f" else -0.3)):
                rows += [("c", family, s, f"agency_margin_tau_{tau}", 0.5 + gain + s / 1000, 0.4 - gain), ("c", family, s, f"set_acsa_tau_{tau}", 0.5, 0.4)]
    units = spark.createDataFrame(rows, "candidate_id string, split_family string, subject_id int, policy string, active_macro_f1 double, active_risk_coverage_auc double").withColumn("day", F.lit(None).cast("string"))
    pairs = inference.candidate_pairwise(units, ["subject_id", "day"], list(reports.PRIMARY), reports.LOWER, 200).withColumn("candidate_id", F.lit("c"))
    assert {r.unit_cols for r in pairs.collect()} == {"subject_id"}
    r = reports.candidate_summary(pairs, units).first()
    assert (r.qualifying_taus, r.qualifying_tau_count, r.all_families_passed, r.active_f1_cells, r.active_risk_cells, r.split_family_count) == ("0.05", 1, True, 3, 3, 2)
    assert abs(r.best_active_macro_f1 - 0.811) < 1e-12 and abs(r.best_active_risk_coverage_auc - 0.1) < 1e-12
    none = reports.candidate_summary(pairs.limit(0), units.where("policy like 'set%'")).first()
    assert (none.qualifying_taus, none.split_family_count, none.best_active_macro_f1, none.best_active_risk_coverage_auc) == ("", 0, 0.0, 1.0)
    with pytest.raises(Exception, match="no unit columns"):
        inference.unit_columns(units, ["day"]).collect()


def test_anchor_checks_leave_out_what_has_no_rows(spark):
    seen = spark.createDataFrame([("other", 0.1, 0.2, 0.3, 0.4)], "dataset_id string, user_macro_f1 double, assist_macro_f1 double, best_agency_macro_f1 double, best_agency_active_macro_f1 double")
    pairs = spark.createDataFrame([("main", "f", m, "0.05", True, True) for m in reports.PRIMARY] + [("main", "g", reports.PRIMARY[0], "0.05", False, True)], "dataset_id string, split_family string, metric string, tau string, holm_reject boolean, beneficial boolean")
    ids = spark.createDataFrame([("a",)], "id string")
    got = {r.check: r.passed for r in reports.anchor_checks(seen, pairs, "main", ["other"], ids, "b").collect()}
    # family g has no rejected row, so it takes no part
    assert got == {"exclusion_matched": False, "external_direction": True, "primary_significance": True}


def test_stress_levels(spark):
    df = spark.range(200).select("id", F.array([F.lit(float(k)) for k in (3, 4, 0, 0)]).alias("features"))
    r = signal.noise_stress(df, "id", [10], 5).select(F.explode(F.zip_with("features", F.array([F.lit(float(k)) for k in (3, 4, 0, 0)]), lambda x, y: x - y)).alias("d")).agg(F.avg("d").alias("m"), F.avg(F.col("d") * F.col("d")).alias("p")).first()
    assert abs(r.m) < 0.1 and 0.5 < r.p < 0.75  # power 25 / 4, a tenth of it
    r = signal.missing_modality_stress(df.limit(1), {"a": ["features"], "b": []}).orderBy("missing").collect()
    assert [x.features for x in r] == [[0.0] * 4, [3.0, 4.0, 0.0, 0.0]]


def test_dev_holdout_with_a_label_of_one_row(spark):
    df = spark.range(300).select(F.col("id").alias("row_id"), F.when(F.col("id") == 0, 9).otherwise((F.col("id") % 2).cast("int")).alias("label"))
    assert splits.dev_holdout(df, 0.25).where("role = 'dev'").count() == 75
    both = splits.dev_holdout(df.where("label <> 9"), 0.1).join(df, "row_id").where("role = 'dev'").groupBy("label").count().collect()
    assert {(r.label, r["count"]) for r in both} == {(0, 14), (1, 15)}
    assert splits.dev_holdout(df.limit(0), 0.1).count() == 0


def test_fingerprints_tell_members_apart(spark):
    a = spark.createDataFrame([(1, "x", "y"), (1, "p", None), (2, "x|y", "")], "part int, u string, v string")
    b = spark.createDataFrame([(2, "x", "y"), (1, "p", None), (1, "x", "y")], "part int, u string, v string")
    one, two = ({r.part: r.fingerprint for r in files.part_fingerprints(d, "part", ["u", "v"]).collect()} for d in (a, b))
    assert one[1] == two[1] and one[2] != two[2]


def test_synthetic_traces(spark):
    g = reports.synthetic_grid(spark, subjects=8, trials=10)
    t = reports.synthetic_traces(g)
    assert g.where("group = 'amputee'").select("subject").distinct().count() == 2 and t.count() == 320
    assert t.where("abs(aggregate(p_user, 0D, (s, x) -> s + x) - 1) > 1e-9").count() == 0
