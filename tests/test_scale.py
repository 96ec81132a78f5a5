"""Operators that must not bind a group to one task: same results as the plain way, whatever the groups hold."""

import math
import random
import statistics
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from heddle.operators import budget, fusion, inference, metrics, ordered, policies, scoring, sequences, splits, trees
from heddle.operators import signal as sig
from heddle.plans import model_queries
from heddle.sources import files, parts, views

DATA = "/root/testdata/sf0.001"


def test_running_sums_with_far_values_and_nulls(spark):
    r = random.Random(1)
    values = {("a", v): r.randrange(9) for v in [0.0, 1e-300, -1e300, 1e300, 5.0, 5.000000001, *[r.gauss(0, 1) for _ in range(200)]]}
    values |= {("b", 1.0): 3}
    df = spark.createDataFrame([(g, v, n) for (g, v), n in values.items()], "g string, v double, n long").repartition(3)
    for row in ordered.running_sums(df, ["g"], "v", ["n"]).collect():
        own = {v: n for (g, v), n in values.items() if g == row.g}
        assert row.n_upto == sum(n for v, n in own.items() if v <= row.v) and row.n_all == sum(own.values())
    assert {x.n_upto for x in ordered.running_sums(df.where("g = 'b'").drop("g"), [], "v", ["n"]).collect()} == {3}
    assert ordered.running_sums(df.where("false"), ["g"], "v", ["n"]).count() == 0


@pytest.mark.parametrize("kind", ["ties", "normal", "far", "one"])
def test_exact_quantiles(spark, kind):
    r = random.Random(2)
    draw = {"ties": lambda: float(r.randrange(3)), "normal": lambda: r.gauss(5, 1), "far": lambda: r.choice([1e300, -1e200, 1.0, 1.0 + 1e-12, 0.0]), "one": lambda: 7.0}[kind]
    values = {g: [draw() for _ in range(n)] for g, n in (("a", 501), ("b", 2), ("c", 1))}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("a", float("nan")), ("d", None)]
    got = ordered.exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(4), ["g"], "v", [0.0, 0.1, 0.5, 1.0])
    assert set(got) == {("a",), ("b",), ("c",)}
    for g, vs in values.items():
        vs = sorted(vs)
        for share, x in zip((0.0, 0.1, 0.5, 1.0), got[(g,)], strict=True):
            k = share * (len(vs) - 1)
            low, high = vs[math.floor(k)], vs[min(math.floor(k) + 1, len(vs) - 1)]
            assert math.isclose(x, low if low == high else low + (high - low) * (k - math.floor(k)), rel_tol=1e-12)
    assert ordered.exact_quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", [0.5]) == {}


def test_robust_z_and_standardize(spark):
    r = random.Random(3)
    x = [[r.gauss(0, 1), float(r.randrange(2)), 4.0] for _ in range(99)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "row_id long, features array<double>")
    z = {row.row_id: row.features for row in sig.robust_z(df, "row_id").collect()}
    s = {row.row_id: row.features for row in sig.standardize(df, df, "row_id").collect()}
    for i in range(3):
        column = [v[i] for v in x]
        med = statistics.median(column)
        mad = statistics.median([abs(v - med) for v in column])
        mean, dev = statistics.fmean(column), statistics.pstdev(column)
        for k, v in enumerate(column):
            assert math.isclose(z[k][i], (v - med) / (1.4826 * mad + 1e-8), abs_tol=1e-6)
            assert math.isclose(s[k][i], (v - mean) / (dev if dev >= 1e-6 else 1.0), abs_tol=1e-9)


def test_bank_places(spark):
    bank = sorted({0.0, 1.01, *[k / 7 for k in range(8)]})
    df = spark.createDataFrame([(v,) for v in [-1.0, 0.0, 0.1, 1 / 7, 0.5, 1.0, 1.01, 2.0]], "v double")
    for row in budget.bank_place(df, "v", bank, "k").collect():
        assert row.k == sum(b <= row.v for b in bank) - 1


def test_units_in_parts_equal_units_in_one_task(spark):
    """One unit holds most rows, most of them of one confidence; its rows lie in many tasks."""
    t = views.base_traces(spark, DATA).withColumns({"split_id": F.lit("all|x"), "session": F.when(F.col("dk") > 2, F.col("session"))})
    d = policies.policy_grid(t, (0.1,)).withColumn("coverage", F.when(F.col("event_id") % 3 > 0, 0.9).otherwise(F.col("coverage")))
    unit = ["split_id", "policy", "session"]
    whole = metrics.unit_metrics(d, unit, views.CLASSES, split=False)
    cut = metrics.unit_metrics(d, unit, views.CLASSES, split=True)
    key = lambda r: (r.policy, str(r.session))
    a, b = (sorted(x.collect(), key=key) for x in (whole, cut))
    assert len(a) == len(b) > 10
    for x, y in zip(a, b, strict=True):
        assert all(p == q or math.isclose(p, q, rel_tol=1e-9) for p, q in zip(x, y, strict=True))
    got = metrics.risk_coverage(d, unit, "event_id", split=True).groupBy().agg(F.sum("risk_coverage_auc")).first()[0]
    assert math.isclose(got, metrics.risk_coverage(d, unit, "event_id", split=False).groupBy().agg(F.sum("risk_coverage_auc")).first()[0], rel_tol=1e-9)


def test_decisions_made_before_splits_equal_those_after(spark):
    b = views.base_traces(spark, DATA).limit(40).localCheckpoint()
    names = ["event_id", "split_id", "policy", "selected_action", "coverage", "expected_ali"]
    grid = lambda: F.array(*[policies.margin_budget(policies.Staged(), t) for t in (0.05, 0.2)])
    after = policies.expand(views.by_split(b), grid())
    staged = policies.stage(b)
    assert policies.stage(staged).columns == staged.columns
    for d in (views.by_split(policies.expand(b, grid())), policies.expand(views.by_split(staged), grid())):
        assert sorted(d.columns) == sorted(after.columns)
        assert sorted(map(tuple, d.select(names).collect())) == sorted(map(tuple, after.select(names).collect()))


def test_classes_come_from_the_vector(spark):
    p = [0.05] * 9 + [0.55]
    row = [(1, "s|a", "p", 9, 9, True, True, 0.1, 0.5, 100.0, p)]
    d = spark.createDataFrame(row, "event_id long, split_id string, policy string, label int, selected_action int, correct boolean, intervene boolean, expected_ali double, coverage double, decision_time_ms double, probs array<double>")
    m = metrics.unit_metrics(d, ["split_id", "policy"]).first()
    assert m.accuracy == 1.0 and math.isclose(m.macro_f1, 0.1) and math.isclose(m.balanced_accuracy, 0.1)
    assert math.isclose(metrics.class_metrics(d, ["policy"]).first().macro_f1, 0.1)
    for run in (lambda: metrics.unit_metrics(d, ["policy"], 5), lambda: metrics.class_metrics(d, ["policy"], 5)):
        with pytest.raises(Exception, match="beyond 5 classes"):
            run().collect()


def test_null_fields_are_violations(spark):
    d = policies.policy_grid(views.base_traces(spark, DATA), (0.1,)).where("event_id = 1 and policy = 'assist_only'")
    assert policies.decision_violations(d).count() == 0
    for c in ("label", "selected_action", "tau", "expected_ali", "margin", "confidence", "coverage", "probs"):
        kind = dict(d.dtypes)[c]
        assert policies.decision_violations(d.withColumn(c, F.lit(None).cast(kind))).count() == 1, c
        if kind == "double":
            for bad in (float("nan"), float("inf")):
                assert policies.decision_violations(d.withColumn(c, F.lit(bad))).count() == 1, c


# resampling


def test_bootstrap_of_many_values_and_of_one(spark):
    r = random.Random(4)
    values = [r.gauss(2, 1) for _ in range(5000)]
    rows = [("many", v) for v in values] + [("ties", float(k % 2)) for k in range(400)] + [("one", 3.0)] + [("many", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    before, inference.BLOCK = inference.BLOCK, 256
    try:
        got = {x.g: x for x in inference.bootstrap_ci(df, "v", ["g"], 1000).collect()}
        p = {x.g: x for x in inference.signflip_p(df, "v", ["g"], 500).collect()}
    finally:
        inference.BLOCK = before
    for g, own in (("many", values), ("ties", [float(k % 2) for k in range(400)])):
        error = statistics.pstdev(own) / math.sqrt(len(own))
        assert got[g].n == len(own) and math.isclose(got[g].estimate, statistics.fmean(own))
        assert abs((got[g].ci_high - got[g].ci_low) / 2 / (1.96 * error) - 1) < 0.15
        assert abs((got[g].ci_high + got[g].ci_low) / 2 - got[g].estimate) < error / 3
    assert (got["one"].ci_low, got["one"].ci_high, p["one"].p_value) == (3.0, 3.0, 1.0)
    assert p["many"].p_value <= 1 / 501 + 1e-12


def test_flips_follow_the_normal_law(spark):
    r = random.Random(6)
    rows = [(k, r.gauss(0.1, 1)) for k in range(60) for _ in range(80)]
    p = {x.g: x.p_value for x in inference.signflip_p(spark.createDataFrame(rows, "g long, v double"), "v", ["g"], 2000).collect()}
    for g in range(60):
        own = [v for k, v in rows if k == g]
        z = abs(sum(own)) / math.sqrt(sum(v * v for v in own))
        assert abs(p[g] - math.erfc(z / math.sqrt(2))) < 0.06


def test_nested_bootstrap_is_wider_where_clusters_differ(spark):
    r = random.Random(7)
    means = [r.gauss(0, 1) for _ in range(20)]
    rows = [("x", str(c), k, means[c] + 0.01 * r.gauss(0, 1)) for c in range(20) for k in range(50)]
    df = spark.createDataFrame(rows, "p string, c string, u long, v double")
    before, inference.BLOCK = inference.BLOCK, 8
    try:
        nested = inference.nested_bootstrap_ci(df, "v", ["c", "u", "absent"], ["p"], 800).first()
    finally:
        inference.BLOCK = before
    error = statistics.pstdev(means) / math.sqrt(20)
    assert abs((nested.ci_high - nested.ci_low) / 2 / (1.96 * error) - 1) < 0.25
    plain = inference.bootstrap_ci(df, "v", ["p"], 800).first()
    assert nested.ci_high - nested.ci_low > 3 * (plain.ci_high - plain.ci_low) and math.isclose(nested.estimate, plain.estimate)


def test_clusters_of_one_need_no_draws(spark):
    r = random.Random(8)
    rows = [("x", str(c), k, None, r.gauss(0, 1)) for c in range(5) for k in range(40)] + [("y", "0", 0, None, 2.0)]
    df = spark.createDataFrame(rows, "p string, c string, u long, d string, v double")
    deep, flat = ({x.p: x for x in inference.nested_bootstrap_ci(df, "v", names, ["p"], 200).collect()} for names in (["c", "u", "d"], ["c", "u"]))
    assert set(deep) == {"x", "y"} and deep["y"].ci_low == deep["y"].ci_high == 2.0
    for p in deep:
        assert all(math.isclose(deep[p][c], flat[p][c], abs_tol=1e-12) for c in ("estimate", "ci_low", "ci_high"))
    # one sub-cluster each: none is dealt out for draws
    nodes = df.select("p", "c", "u", F.lit("").alias("d"), F.col("v").alias("_s"), F.lit(1.0).alias("_c"))
    assert inference._dealt(nodes, ["p", "c", "u"], "d", 2, 1).count() == 0
    assert inference._dealt(nodes, ["p", "c"], "u", 1, 1).count() == 5


def test_exact_flips_say_so(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(1, 5)] + [("b", float(k)) for k in range(1, 20)], "g string, v double")
    got = {x.g: x for x in inference.exact_signflip_p(df, "v", ["g"]).collect()}
    assert got["a"].exact and got["a"].p_value == 2 / 16 and not got["b"].exact


def test_no_pairs_is_an_error(spark):
    u = spark.createDataFrame([], "unit int, policy string, m double")
    with pytest.raises(Exception, match="no paired units"):
        inference.paired_test(u, ["unit"], "a", "b", "m").collect()


# splits


def odd_rows(spark):
    rows = [(k, None if k % 9 == 0 else f"g{k % 5}", k % 5 < 2, f"day{k % 4 + 8}") for k in range(90)]
    return spark.createDataFrame(rows, "row_id long, g string, target boolean, day string").withColumns({"_g": F.lit(1), "_r": F.lit(2), "_fold": F.lit(3), "fold": F.lit(4), "role": F.lit("x")})


def test_totals_equal_members(spark):
    df = odd_rows(spark)
    flagged = df.withColumn("group", F.when(F.col("target"), "target").otherwise("background")).withColumn("subject_id", F.col("g"))
    families = [splits.logo_family(df, "g"), splits.kfold_family(df, "g", 3), splits.heldout_family(flagged, "group", "target"), splits.forward_family(df, "day", True), splits.population_family(flagged)]
    for f in families:
        sums = f.totals({"ids": F.col("row_id")}).collect()
        counted = f.members().groupBy("split_id", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids")).collect()
        assert {(r.split_id, r.role, r.n, r.ids) for r in sums} == {(r.split_id, r.role, r.n, r.ids) for r in counted}
        first = f.splits.orderBy("split_id").first().split_id
        assert f.members([first]).count() == f.members().where(F.col("split_id") == first).count()


def test_leaks_of_a_family_equal_those_of_its_members(spark):
    r = random.Random(12)
    rows = [(k, r.choice(["a", "b", "c", None]), r.choice(["target", "background"]), f"day{r.randrange(4)}", r.choice([*range(12), None])) for k in range(60)]
    rows += [(5, "a", "target", "day0", 99), (5, "b", "background", "day3", 98)]
    df = spark.createDataFrame(rows, "row_id long, subject_id string, group string, day string, code int")
    found = []
    for f in (splits.logo_family(df, "subject_id"), splits.forward_family(df, "day"), splits.population_family(df)):
        got = sorted(map(tuple, splits.family_leakage(f, df, ["code", "row_id"]).collect()))
        assert got == sorted(map(tuple, splits.leakage(f.members(), df, ["code"]).collect()))
        found += got
    assert {"row_id", "code"} == {k for _, k, _ in found}
    with pytest.raises(KeyError):
        splits.family_leakage(splits.logo_family(df, "subject_id"), df, ["none"])


def test_null_groups_are_a_group(spark):
    df = odd_rows(spark)
    m = splits.group_k_fold(df, "g", 3)
    assert m.where("role = 'test'").count() == 90 and m.count() == 270
    named = df.withColumn("group", F.coalesce("g", F.lit("none")))
    assert splits.leakage(m, named.select("row_id", "group"), ["group"]).count() == 0


def test_many_groups_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(splits, "HEAVY", 5)
    df = spark.range(20_000).select(F.col("id").alias("row_id"), F.floor(F.sqrt("id")).alias("g"))
    loads = [r.n for r in splits.kfold_family(df, "g", 4).totals().where("role = 'test'").collect()]
    assert sum(loads) == 20_000 and max(loads) - min(loads) <= 2 * 282


def test_splits_without_a_side_go(spark):
    one = spark.createDataFrame([(1, "a"), (2, "a")], "row_id long, g string")
    assert splits.leave_one_group_out(one, "g").count() == 0
    assert splits.leave_one_group_out(one.where("false"), "g").count() == 0


# models


def test_temporal_forest_sees_what_order_tells(spark):
    s = views.sequences(spark, "/root/testdata/sf0.01").withColumn("half", F.col("row_id") % 2)
    members = splits.logo_family(s, "half").members(["logo|0"])
    accuracy = lambda p: p.join(s.select("row_id", "label"), "row_id").agg(F.avg((F.element_at("p", 2) > 0.5).cast("int") * F.col("label") + (F.element_at("p", 2) <= 0.5).cast("int") * (1 - F.col("label")))).first()[0]
    with_order = accuracy(scoring.temporal_forest(s, members, 2, trees=40))
    without = accuracy(scoring.fit_score(s.select("row_id", "label", "features"), members, "forest", 2, trees=40))
    assert with_order > 0.8 and with_order > without + 0.15


def test_sequences_are_dealt_once(spark):
    assert views.sequences(spark, DATA)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_rows_of_fits_and_members_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = labelled(spark)
    slow = df.mapInArrow(count, df.schema)
    got = scoring.fit_score(slow, lambda rows: splits.leave_one_group_out(rows, "fold"), "lda", 2)
    assert sorted(map(tuple, got.select("split_id", "row_id", "role").collect())) == [(f"logo|{k}", r.row_id, "test") for k in range(3) for r in df.where(F.col("fold") == k).orderBy("row_id").collect()]
    assert made.value == 400


def test_forests_of_many_rows_take_few_nodes_at_once(spark, monkeypatch):
    at_once = lambda rows: scoring.estimator("forest", 102, 2, rows=rows).getMaxMemoryInMB()
    assert at_once(scoring.MANY_ROWS) == scoring.FEW_NODES_MB < at_once(scoring.MANY_ROWS - 1) == 256
    monkeypatch.setattr(scoring, "MANY_ROWS", 1)
    monkeypatch.setattr(scoring, "FEW_NODES_MB", 1)
    r = random.Random(4)
    rows = [(k, int(x[0] * x[1] > 0), x, k % 2) for k in range(600) for x in [[r.uniform(-1, 1) for _ in range(6)]]]
    df = spark.createDataFrame(rows, "row_id long, label int, features array<double>, fold int")
    p = scoring.fit_score(df, splits.leave_one_group_out(df, "fold"), "forest", 2, trees=200).join(df, "row_id")
    assert p.count() == 600 and p.where((F.element_at("p", 2) > 0.5).cast("int") == F.col("label")).count() > 480


def test_sequence_errors(spark):
    row = ([[1.0]], [1.0])
    names = [c for m in sequences.ASSIST for c in (m.values, m.mask)]
    schema = "row_id long, features array<double>, " + ", ".join(f"{n} {'array<double>' if n.endswith('mask') else 'array<array<double>>'}" for n in names)
    good = spark.createDataFrame([(1, [1.0], *[x for _ in sequences.ASSIST for x in row])], schema)
    assert len(sequences.temporal_features(good).first().features) == 1 + 6 * sequences.width(1, 4)
    with pytest.raises(ValueError, match="missing sequences"):
        sequences.temporal_features(good.drop("assist_gyr"))
    with pytest.raises(Exception, match="null in some row"):
        sequences.temporal_features(good.withColumn("assist_gyr", F.lit(None).cast("array<array<double>>"))).collect()
    assert sequences.temporal_features(good.where("false")).count() == 0


def labelled(spark, n=400):
    r = random.Random(8)
    rows = [(k, k % 2, [(k % 2) * 2 + r.gauss(0, 0.5), r.gauss(0, 1)], k % 3) for k in range(n)]
    return spark.createDataFrame(rows, "row_id long, label int, features array<double>, fold int")


def test_fits_read_their_rows_from_a_folder(spark, monkeypatch):
    seen = {}

    def look(own, *rest):
        seen[own.first().split_id] = ("Join" in own._jdf.queryExecution().toString(), {(r.row_id, r.role, r.label, tuple(r.v)) for r in own.collect()})

    monkeypatch.setattr(scoring, "_fit_one", look)
    df = spark.createDataFrame([(k, k % 2, [float(k), 1.0], k % 3) for k in range(30)], "row_id long, label int, features array<double>, fold int")
    assert scoring.fit_score(df, splits.leave_one_group_out(df, "fold"), "logistic", 2).count() == 0
    # joined once for all splits, so that no pass of a fit joins or broadcasts again
    assert set(seen) == {"logo|0", "logo|1", "logo|2"} and not any(joins for joins, _ in seen.values())
    for split, (_, rows) in seen.items():
        assert rows == {(k, "test" if f"logo|{k % 3}" == split else "train", k % 2, (float(k), 1.0)) for k in range(30)}


def test_failed_splits_are_kept_apart(spark, monkeypatch):
    df = labelled(spark)
    members = splits.leave_one_group_out(df, "fold")
    real = scoring._fit_one

    def broken(own, *rest):
        if own.first().split_id == "logo|1":
            raise ValueError("planted")
        return real(own, *rest)

    monkeypatch.setattr(scoring, "_fit_one", broken)
    failures = {}
    got = scoring.fit_score(df, members, "lda", 2, failures=failures)
    assert set(failures) == {"logo|1"} and {r.split_id for r in got.select("split_id").distinct().collect()} == {"logo|0", "logo|2"}
    with pytest.raises(RuntimeError, match="planted"):
        scoring.fit_score(df, members, "lda", 2)


def test_discriminant_equals_the_closed_form(spark):
    import numpy as np

    df = labelled(spark)
    members = splits.logo_family(df, "fold").members(["logo|0"])
    got = {r.row_id: r.p for r in scoring.fit_score(df, members, "lda", 2).collect()}
    rows = df.collect()
    train = [r for r in rows if r.fold != 0]
    x, y = np.array([r.features for r in train]), np.array([r.label for r in train])
    means = [x[y == k].mean(axis=0) for k in (0, 1)]
    scatter = sum(((x[y == k] - means[k]).T @ (x[y == k] - means[k])) for k in (0, 1)) / len(x) + 1e-6 * np.eye(2)
    w = [np.linalg.solve(scatter, m) for m in means]
    for r in rows:
        if r.fold == 0:
            s = np.array([w[k] @ np.array(r.features) - 0.5 * means[k] @ w[k] + np.log((y == k).mean()) for k in (0, 1)])
            e = np.exp(s - s.max())
            assert np.allclose(got[r.row_id], e / e.sum(), atol=1e-9)


def test_stacked_blend_takes_the_better_model(spark):
    df = labelled(spark, 900)
    members = splits.logo_family(df, "fold").members(["logo|0"])
    out = scoring.stacked_blend(df, members, ("lda", "logistic"), 2, share=0.2, iterations=50)
    hit = out.join(df.select("row_id", "label"), "row_id").agg(F.avg((F.element_at("p", F.col("label") + 1) > 0.5).cast("int"))).first()[0]
    assert out.count() == 300 and hit > 0.9


# few sizes: the whole network is for the queries
SMALL = fusion.Network(token=16, heads=2, layers=1, branch=8, tabular=8, epochs=12, rate=1e-2, batch=16)


def test_stacked_query_blends_random_trees_with_the_network(spark, monkeypatch):
    asked = {}

    def whole(df, members, specs, classes, **sizes):
        asked.update(specs=specs, sizes=sizes, columns=set(df.columns))
        return members(df).withColumn("p", F.array(F.lit(1.0), F.lit(0.0)))

    monkeypatch.setattr(scoring, "stacked_blend", whole)
    model_queries.e1f_fit(spark, "/root/testdata/sf0.001")
    assert asked["specs"] == ("extra_trees", "fusion") and not asked["sizes"]
    assert {"features", *[c for m in sequences.ASSIST for c in (m.values, m.mask)]} <= asked["columns"]
    n = fusion.Network()
    assert (n.token, n.heads, n.layers, n.branch, n.tabular, n.batch, n.epochs, n.patience, n.share) == (160, 4, 2, 96, 256, 128, 28, 6, 0.1)


def test_stacked_blend_reads_the_sequences(spark, monkeypatch):
    monkeypatch.setattr(fusion, "PART_ROWS", 128)
    r = random.Random(5)

    def row(k):
        up = k % 2
        rise = [[r.gauss(0, 0.3) + (t if up else 5 - t)] for t in range(6)]
        return (k, up, [r.gauss(0, 1), float(k % 3)], r.randrange(2), *[x for m in sequences.ASSIST for x in (rise if m.values == "assist_gaze" else [[1.0]] * 6, [1.0] * 6)])

    types = ", ".join(f"{m.values} array<array<double>>, {m.mask} array<double>" for m in sequences.ASSIST)
    df = spark.createDataFrame([row(k) for k in range(700)], f"row_id long, label int, features array<double>, half int, {types}")
    family = lambda rows: splits.leave_one_group_out(rows, "half")
    out = scoring.stacked_blend(df, family, ("extra_trees", "fusion"), 2, trees=20, network=SMALL).join(df.select("row_id", "label"), "row_id")
    # the label is told only by the order of samples, which trees on the tabular features don't see
    right = out.where(F.element_at("p", F.col("label") + 1) > 0.5).count()
    assert out.count() == 700 and right > 650
    assert out.where(F.abs(F.element_at("p", 1) + F.element_at("p", 2) - 1) > 1e-6).count() == 0


def test_gradients_of_the_network(spark):
    import numpy as np

    of = fusion.Layout(((6, 2), (6, 1), (6, 3)), 2)
    net = fusion.Network(token=8, heads=2, layers=2, branch=5, tabular=7, dropout=0.2, modality_dropout=0.2)
    spec, r = fusion.shapes(net, of, 3), np.random.default_rng(0)
    flat = fusion.begin(spec, 1).astype(float)
    flat += r.normal(0, 0.05, len(flat))
    x, label = r.normal(size=(9, of.width)), r.integers(0, 3, 9)
    for _, mask in of.cut(x)[0]:
        mask[...] = r.random(mask.shape) < 0.7
    of.cut(x)[0][1][1][:3] = 0
    at = lambda w: fusion.gradient(w, spec, net, of, x, label, np.array([1.0, 2.0, 0.5]), np.random.default_rng(5))
    found, k = at(flat)[1], 0
    for name, (shape, _) in spec.items():
        size = int(np.prod(shape))
        for i in r.choice(size, min(size, 4), replace=False) + k:
            step = np.zeros(len(flat))
            step[i] = 1e-5
            assert abs((at(flat + step)[0] - at(flat - step)[0]) / 2e-5 - found[i]) < 1e-5 + 1e-3 * abs(found[i]), name
        k += size


def test_network_stops_where_held_out_rows_gain_nothing(spark, monkeypatch):
    seen = []
    real = fusion._epoch

    def count(rows, state, parts, epoch, *rest):
        seen.append((epoch, parts))
        return real(rows, state, parts, epoch, *rest)

    monkeypatch.setattr(fusion, "_epoch", count)
    monkeypatch.setattr(fusion, "PART_ROWS", 200)
    of = fusion.Layout(((2, 1),), 1)
    r = random.Random(3)
    df = spark.createDataFrame([("a", k, "train" if k < 300 else "test", k % 2, [r.gauss(0, 1) for _ in range(of.width)]) for k in range(320)], "split_id string, row_id long, role string, label int, x array<float>")
    fit = lambda n, net: fusion.fit(df.where(F.col("row_id") < n), df.where("role = 'test'"), 3, [0, 1], of, net)
    got = fit(300, replace(SMALL, epochs=60, patience=2, rate=0.05))
    # labels are noise: the loss of the held-out rows gets no better for long
    assert 3 <= len(seen) < 61 and {p for _, p in seen} == {2}
    assert got.count() == 20 and all(r.p[2] == 0 and abs(sum(r.p) - 1) < 1e-9 for r in got.collect())
    seen.clear()
    fit(200, replace(SMALL, epochs=60, patience=2)).count()
    assert [e for e, _ in seen] == [0, 1]


def test_random_trees_cut_at_random_places(spark, monkeypatch):
    rows = [(0, 0.0), (1, 1.0)] * 3
    train = spark.createDataFrame([([v], k, 1.0) for k, v in rows], "x array<double>, label int, weight double")
    rest = spark.createDataFrame([(k, [k / 10]) for k in range(-1, 12)], "row_id long, x array<double>")
    grown = lambda: {r.row_id: r.p for r in trees.extra_trees(train, rest, 2, 1, trees=400).collect()}
    p = grown()
    assert len(p) == 13 and p[-1] == p[0] == [1.0, 0.0] and p[10] == p[11] == [0.0, 1.0]
    # a cut lies below a value between the two as often as the value is far
    assert all(abs(p[k][1] - k / 10) < 0.09 for k in range(1, 10))
    monkeypatch.setattr(trees, "PAIRS", 1_500)
    assert all(abs(a - b) < 1e-9 for k, xs in grown().items() for a, b in zip(xs, p[k], strict=True))


def test_random_trees_grow_out(spark):
    # both features tell only together; equal vectors keep the shares of their classes' weights
    cells = [(x, y, (x + y) % 2, 3.0) for x in range(4) for y in range(4)] + [(2, 2, 1, 1.0)]
    train = spark.createDataFrame([([float(x), float(y)], k, w) for x, y, k, w in cells], "x array<double>, label int, weight double")
    rest = spark.createDataFrame([(x, y, [float(x), float(y)]) for x in range(4) for y in range(4)], "a int, b int, x array<double>")
    for r in trees.extra_trees(train, rest, 2, 2, trees=30).collect():
        assert r.p == pytest.approx([0.75, 0.25] if (r.a, r.b) == (2, 2) else [float((r.a + r.b) % 2 == 0), float((r.a + r.b) % 2)])


def test_blends_of_splits(spark):
    rows = [("a", 0, [0.9, 0.1], [0.1, 0.9]), ("a", 1, [0.2, 0.8], [0.9, 0.1]), ("b", 0, [0.1, 0.9], [0.8, 0.2]), ("b", 1, [0.9, 0.1], [0.3, 0.7])]
    v = spark.createDataFrame(rows, "split_id string, label int, p_user array<double>, p_assist array<double>")
    s = spark.createDataFrame([("a",), ("b",), ("c",)], "split_id string")
    assert {r.split_id: r.weight for r in scoring.choose_blends(s, v).collect()} == {"a": 0.0, "b": 1.0, "c": 0.5}


# parts and files


def test_parts_are_read_and_written_once(spark, tmp_path):
    root, asked = str(tmp_path / "parts"), []
    rows = lambda bump: spark.createDataFrame([(p, k, float(k) + (bump if p == "b" else 0)) for p in "abc" for k in range(4)], "part string, k long, v double")

    def refresh(df):
        def build(stale):
            asked.append(sorted(r.part for r in stale.collect()))
            return df.join(stale, "part", "left_semi")

        return {r.part: (r.status, r.rows, r.version) for r in parts.refresh_parts(spark, root, files.part_fingerprints(df, "part", ["k", "v"]), build).collect()}

    assert refresh(rows(0)) == {p: ("new", 4, 1) for p in "abc"}
    assert refresh(rows(0)) == {p: ("fresh", 4, 1) for p in "abc"} and asked == [["a", "b", "c"]]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "parts").rglob("*.parquet")}
    assert refresh(rows(5)) == {"a": ("fresh", 4, 1 + 1), "b": ("changed", 4, 2), "c": ("fresh", 4, 2)} and asked[-1] == ["b"]
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    assert parts.read_parts(spark, root).agg(F.sum("v")).first()[0] == 18 + 20
    assert parts.read_parts(spark, root, 1).agg(F.sum("v")).first()[0] == 18
    last = rows(5).where("part <> 'c'")
    assert refresh(last)["c"][0] == "removed" and parts.read_parts(spark, root).count() == 8
    assert parts.drop_old_runs(spark, root) == [] and parts.read_parts(spark, root).count() == 8


def test_a_broken_run_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "parts")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "part string, k long")
    prints = lambda d: files.part_fingerprints(d, "part", ["k"])
    parts.refresh_parts(spark, root, prints(df), lambda stale: df.join(stale, "part", "left_semi"))
    changed = df.withColumn("k", F.col("k") + 1)
    with pytest.raises(Exception, match="planted"):
        parts.refresh_parts(spark, root, prints(changed), lambda stale: changed.join(stale, "part").withColumn("k", F.when(F.col("k") > 2, F.raise_error(F.lit("planted")).cast("long")).otherwise(F.col("k"))))
    assert parts.current_version(spark, root) == 1 and parts.read_parts(spark, root).agg(F.sum("k")).first()[0] == 3
    parts.refresh_parts(spark, root, prints(changed), lambda stale: changed.join(stale, "part", "left_semi"))
    assert parts.read_parts(spark, root).agg(F.sum("k")).first()[0] == 5


def test_digests_and_lines_by_ranges(spark, tmp_path):
    import hashlib

    contents = {"a.csv": b"h\n" + b"1,2\n" * 999, "b.json": b"{}\n\n  \n{}\n{}", "c.bin": bytes(range(256)) * 40, "d.jsonl": b"", "e.json": b"\n\n", "f.csv": b"x" * 5000 + b"\n" + b"y" * 3000}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    f = files.listed_files(spark, str(tmp_path))
    digests = []
    for step in (1024, 4096, 1 << 20):
        got = {r.path.rsplit("/", 1)[1]: r.tree_sha256 for r in files.tree_digests(f, 1024, step).collect()}
        digests.append(got)
    assert digests[0] == digests[1] == digests[2] and set(digests[0]) == set(contents)
    for name, data in contents.items():
        leaves = "".join(hashlib.sha256(data[k : k + 1024]).hexdigest() for k in range(0, max(len(data), 1), 1024))
        assert digests[0][name] == hashlib.sha256(leaves.encode()).hexdigest()
    for step in (7, 1000, 1 << 20):
        lines = {r.path.rsplit("/", 1)[1]: (r.lines, r.full) for r in files.line_counts(f.where("extension <> '.bin'"), step).collect()}
        for name, data in contents.items():
            if name != "c.bin":
                want = data.decode().split("\n")
                want = want[:-1] if want[-1] == "" else want
                assert lines[name] == (len(want), sum(bool(x.strip()) for x in want)), (name, step)
    m = {r.path.rsplit("/", 1)[-1]: r for r in files.output_manifest(spark, str(tmp_path), {"grid": "1"}).collect()}
    assert m["a.csv"].rows == 999 and m["b.json"].rows == 3 and m["c.bin"].rows is None and m["c.bin"].kind == "other" and m["grid"].role == "config"


def test_prepared_tables_are_checked(spark, tmp_path):
    path = str(tmp_path / "p")
    files.write_prepared(spark.range(10), path)
    assert files.read_prepared(spark, path).count() == 10
    spark.range(3).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="10 rows"):
        files.read_prepared(spark, path)


def test_merged_parts_have_like_sequences(spark):
    a = spark.createDataFrame([([1.0], {"emg": [1.0]})], "f array<double>, seq map<string,array<double>>")
    assert files.merge_prepared([a, a], "f", "seq").count() == 2
    for other in (spark.createDataFrame([([1.0], {"acc": [1.0]})], a.schema), spark.createDataFrame([([1.0], None)], a.schema)):
        with pytest.raises(ValueError, match="sequence keys"):
            files.merge_prepared([a, other], "f", "seq")
    with pytest.raises(ValueError, match="widths"):
        files.merge_prepared([a, spark.createDataFrame([([1.0, 2.0], {"emg": [1.0]})], a.schema)], "f", "seq")


def test_backfill_refuses(spark):
    from heddle.operators import clean

    df = spark.createDataFrame([("main", 1.0)], "dataset_id string, m double")
    assert clean.backfill_columns(df, {"active_m": "m"}).first().active_m == 1.0
    with pytest.raises(ValueError, match="own values"):
        clean.backfill_columns(df, {"active_m": "m"}, "main")
    assert clean.backfill_columns(df, {"m": "m"}, "main").columns == df.columns
    assert clean.backfill_columns(df, {"active_m": "m"}, "other").first().active_m == 1.0


# streams


def test_episodes_on_a_stream_equal_the_batch(spark, tmp_path):
    from heddle.operators import timing
    from heddle.streaming.episodes import stream_episodes

    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t = views.base_traces(spark, DATA).withColumn("split_id", F.lit("all|x")).where("event_id < 400")
    d = policies.policy_grid(t, (0.1,)).where("policy in ('assist_only', 'agency_margin_tau_0.10')").withColumn("event_time", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id")))
    names = ["event_time", "dataset_id", "split_id", "policy", "subject_id", "session", "day", "episode_id", "prefix_time_s", "timestamp_s", "event_id", "selected_action", "intervene", "correct", "expected_ali", "tau", "label"]
    d = d.select(*names)
    want = timing.earliest_by_episode(d)
    source = tmp_path / "in"
    for k in range(3):  # rows in any order inside the watermark, over three batches
        d.where(F.pmod(F.hash("event_id"), F.lit(3)) == k).orderBy(F.xxhash64("event_id")).coalesce(1).write.mode("append").parquet(str(source))
    late = d.limit(1).withColumn("event_time", F.timestamp_seconds(F.lit(1_800_000_000))).withColumn("episode_id", F.lit("sentinel"))
    try:
        run = lambda: stream_episodes(spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(source)), late="1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
        run()
        late.coalesce(1).write.mode("append").parquet(str(source))
        run()
    finally:
        spark.conf.unset(key)
    got = spark.read.parquet(str(tmp_path / "out"))
    cols = ["policy", "episode_id", "n_prefixes", "final_action", *timing.TIMES]
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, (tuple(r) for r in want.select(*cols).collect())))


def test_rates_by_time_on_a_stream(spark, tmp_path):
    from heddle.streaming.decisions import windowed_rates

    d = policies.policy_grid(views.base_traces(spark, DATA).where("event_id < 60"), (0.1,)).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") * 120))
    d = d.select("at", "policy", "intervene", "correct")
    d.write.parquet(str(tmp_path / "in"))
    want = d.groupBy(F.window("at", "1 hour").start.alias("start"), "policy").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    q = windowed_rates(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), "at").writeStream.format("memory").outputMode("complete").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("rates").select(F.col("window.start").alias("start"), "policy", "n", "accuracy")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_budgets_are_attached_one_to_one(spark):
    row = ("d", "f", "f|1", "p", "s", None, None)
    keys = ", ".join(f"{k} string" for k in budget.BUDGET_KEYS)
    u = spark.createDataFrame([row], keys)
    b = spark.createDataFrame([(*row, 0.25)], keys + ", intervention_rate double")
    assert budget.attach_budget(u, b).first().intervention_rate == 0.25
    for units, budgets, what in ((u, b.union(b), "duplicate budget"), (u.union(u), b, "duplicate unit"), (u, b.where("false"), "missing budget")):
        with pytest.raises(Exception, match=what):
            budget.attach_budget(units, budgets).collect()
    with pytest.raises(ValueError, match="units lack"):
        budget.attach_budget(u.drop("day"), b)


def test_manifests_that_are_not_json_break_their_rules(spark, tmp_path):
    from heddle.operators import reports

    (tmp_path / "a.json").write_text('{"dataset": "d", "prepared_root": "r", "user_model": "u", "assist_model": "a", "trace_count": 2, "decision_count": 36, "pairwise_repeats": 10, "split_families": ["x", "y"]}')
    (tmp_path / "b.json").write_text("not json")
    m = reports.read_manifests(spark, str(tmp_path), "publication")
    broken = {(r.path.rsplit("/", 1)[1], r.rule) for r in reports.manifest_violations(m, "publication", "path").collect()}
    assert {p for p, _ in broken} == {"b.json"} and len(broken) == 8
    with pytest.raises(ValueError, match="unknown kind"):
        reports.read_manifests(spark, str(tmp_path), "other")
