"""Gates and report tables over comparison rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions.arrays import argmax, normalize
from heddle.operators.policies import policy_family, tau_token

PRIMARY = ("active_macro_f1", "active_risk_coverage_auc")
SAFETY = ("median_earliest_safe_s", "median_earliest_stable_safe_s")
LOWER = ("active_risk_coverage_auc", "median_earliest_safe_s", "median_earliest_stable_safe_s")
CRITERIA = ("dataset", "task_family", "split_shift", "population", "adaptation", "decision_object", "metric")


def _n(test: Column) -> Column:
    return F.sum(F.coalesce(test, F.lit(False)).cast("long"))


def candidate_eval(pairwise: DataFrame) -> DataFrame:
    """tau, passed: whether both metrics are rejected and beneficial in every family."""
    good = F.col("holm_reject") & F.col("beneficial")
    families = pairwise.agg(F.count_distinct("split_family").alias("all"))
    by = pairwise.groupBy("tau").agg(*[F.count_distinct(F.when(good & (F.col("metric") == m), F.col("split_family"))).alias(m) for m in PRIMARY])
    return by.crossJoin(F.broadcast(families)).select("tau", *PRIMARY, ((F.col(PRIMARY[0]) == F.col("all")) & (F.col(PRIMARY[1]) == F.col("all"))).alias("passed"))


def qualifying_taus(rows: DataFrame, families: DataFrame) -> DataFrame:
    """tau: those with rejected, beneficial rows of both metrics in every family (families: one row, `all`)."""
    good = F.col("holm_reject") & F.col("beneficial")
    by = rows.where("tau is not null").groupBy("tau").agg(*[F.count_distinct(F.when(good & (F.col("metric") == m), F.col("split_family"))).alias(m) for m in PRIMARY])
    return by.crossJoin(F.broadcast(families)).where((F.col(PRIMARY[0]) == F.col("all")) & (F.col(PRIMARY[1]) == F.col("all"))).select("tau")


def candidate_summary(pairwise: DataFrame, aggregate: DataFrame) -> DataFrame:
    """One row per candidate_id: qualifying taus, beneficial cells, families and the best margin values.

    A candidate without comparisons has no taus and 0 cells; one without margin
    policies the worst values, 0 and 1.
    """
    key = "candidate_id"
    good = F.col("holm_reject") & F.col("beneficial")
    in_ = lambda m: F.coalesce(good & (F.col("metric") == m), F.lit(False))
    cells = pairwise.groupBy(key).agg(F.count_if(in_(PRIMARY[0])).alias("active_f1_cells"), F.count_if(in_(PRIMARY[1])).alias("active_risk_cells"), F.count_distinct("split_family").alias("split_family_count"))
    by = pairwise.where("tau is not null").groupBy(key, "tau").agg(*[F.count_distinct(F.when(in_(m), F.col("split_family"))).alias(m) for m in PRIMARY])
    passed = by.join(cells, key).where((F.col(PRIMARY[0]) == F.col("split_family_count")) & (F.col(PRIMARY[1]) == F.col("split_family_count")))
    taus = passed.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("tau")), "|").alias("qualifying_taus"), F.count_distinct("tau").alias("qualifying_tau_count"))
    margin = F.col("policy").startswith("agency_margin_tau_")
    best = aggregate.groupBy(key).agg(F.max(F.when(margin, F.col(PRIMARY[0]))).alias("f1"), F.min(F.when(margin, F.col(PRIMARY[1]))).alias("risk"))
    out = best.join(cells, key, "full").join(taus, key, "left").fillna(0, ["active_f1_cells", "active_risk_cells", "split_family_count", "qualifying_tau_count"]).fillna("", ["qualifying_taus"])
    return out.select(
        key, "qualifying_taus", "qualifying_tau_count", (F.col("qualifying_tau_count") > 0).alias("all_families_passed"), "active_f1_cells", "active_risk_cells", "split_family_count",
        F.coalesce("f1", F.lit(0.0)).alias("best_active_macro_f1"), F.coalesce("risk", F.lit(1.0)).alias("best_active_risk_coverage_auc"),
    )


def candidate_rank(candidates: DataFrame) -> DataFrame:
    """The best candidate: passed, taus, cells, macro-F1, then low risk; names break ties."""
    key = [F.desc("passed"), F.desc("taus"), F.desc("cells"), F.desc("active_macro_f1"), F.asc("active_risk_coverage_auc"), F.asc("candidate_id")]
    return candidates.orderBy(*key).limit(1)


def instability_by_tau(conf: DataFrame, early: DataFrame, required: list[str]) -> DataFrame:
    """Per family and tau: significant and harmful cells on both sides, gaps and matches."""
    keys = ["dataset_id", "split_family", "tau"]
    sig, harm = F.col("beneficial_and_holm_significant"), F.col("holm_reject") & ~F.col("beneficial")
    c = conf.where(F.col("metric").isin(*PRIMARY)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("primary_count"), F.count_distinct(F.when(sig, F.col("metric"))).alias("primary_significant"), _n(harm).alias("primary_harmful"), F.avg("mean_abs_intervention_rate_gap").alias("confidence_gap"), F.avg("exact_match_fraction").alias("confidence_match")
    )
    e = early.where(F.col("metric").isin(*SAFETY)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("safety_count"), _n(sig).alias("safety_significant"), _n(harm).alias("safety_harmful"), F.avg("mean_abs_intervention_rate_gap").alias("earliest_gap"), F.avg("exact_match_fraction").alias("earliest_match")
    )
    out = c.join(e, keys, "full").fillna(0, ["primary_count", "primary_significant", "primary_harmful", "safety_count", "safety_significant", "safety_harmful"])
    return out.withColumn("all_primary_significant", F.col("primary_significant") == len(PRIMARY)).withColumn("scope", F.when(F.col("split_family").isin(*required), "required").otherwise("descriptive"))


def universal_taus(by_tau: DataFrame, required: list[str]) -> DataFrame:
    """Taus that are clean and complete in every required family."""
    ok = F.col("all_primary_significant") & (F.col("primary_harmful") == 0) & (F.col("safety_harmful") == 0) & (F.col("primary_count") >= len(PRIMARY)) & (F.col("safety_count") >= len(SAFETY))
    rows = by_tau.where("scope = 'required'").groupBy("dataset_id", "tau").agg(F.count_distinct("split_family").alias("k"), F.bool_and(ok).alias("ok"))
    return rows.where(F.col("ok") & (F.col("k") == len(set(required)))).select("dataset_id", "tau")


def best_tau(conf: DataFrame) -> DataFrame:
    """dataset, family, metric: the tau with the best signed estimate, the smaller on ties."""
    signed = F.when(F.col("metric").isin(*LOWER), -F.col("estimate")).otherwise(F.col("estimate"))
    w = Window.partitionBy("dataset_id", "split_family", "metric").orderBy(F.desc("_s"), "tau")
    return conf.where(F.col("metric").isin(*PRIMARY)).withColumn("_s", signed).withColumn("_k", F.row_number().over(w)).where("_k = 1").select("dataset_id", "split_family", "metric", F.col("tau").alias("best_tau"))


def metric_disagreement(best: DataFrame) -> DataFrame:
    return best.groupBy("dataset_id", "split_family").agg(F.count_distinct("best_tau").alias("k")).where("k > 1").select("dataset_id", "split_family")


def dataset_overview(by_tau: DataFrame, conf: DataFrame, required: list[str]) -> DataFrame:
    """One row per dataset: families seen and required, universal and best taus and their numbers, worst values, lowest matches, missing families, the story."""
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    rows = by_tau.where("scope = 'required'")
    names = F.array(*map(F.lit, sorted(set(required))))
    seen = by_tau.groupBy("dataset_id").agg(F.count_distinct("split_family").alias("observed_families"), F.array_join(F.array_sort(F.array_except(names, F.collect_set("split_family"))), "|").alias("missing_families"))
    base = rows.groupBy("dataset_id").agg(
        F.max("confidence_gap").alias("worst_confidence_gap"), F.max("earliest_gap").alias("worst_earliest_gap"), F.min("confidence_match").alias("lowest_confidence_match"), F.min("earliest_match").alias("lowest_earliest_match"), F.max("safety_harmful").alias("worst_safety_harmful")
    )
    uni = universal_taus(by_tau, required).groupBy("dataset_id").agg(join("tau").alias("universal_taus"), F.count_distinct("tau").alias("n_universal_taus"))
    best = best_tau(conf.where(F.col("split_family").isin(*required)))
    b = best.groupBy("dataset_id").agg(join("best_tau").alias("best_taus"), F.count_distinct("best_tau").alias("n_best_taus"))
    d = metric_disagreement(best).groupBy("dataset_id").agg(join("split_family").alias("disagreement_families"))
    out = seen.join(base, "dataset_id", "left").join(uni, "dataset_id", "left").join(b, "dataset_id", "left").join(d, "dataset_id", "left")
    out = out.fillna("", ["universal_taus", "best_taus", "disagreement_families"]).fillna(0, ["n_universal_taus", "n_best_taus"])
    return out.withColumn("required_families", F.lit(len(set(required))).cast("long")).withColumn("story", F.when(F.col("universal_taus") != "", "fixed_tau_supported").otherwise("fixed_tau_unstable"))


def overall_instability(overview: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return overview.agg(F.when(n == 0, "no_data").when(F.bool_or(F.col("story") == "fixed_tau_supported"), "mixed_fixed_tau_support").otherwise("fixed_tau_unstable_under_exact_budget").alias("status"))


def best_policy_rows(aggregate: DataFrame) -> DataFrame:
    """Per family: the best policy overall, by active metrics, and of the margin policies; user and assist alone."""
    best = lambda f1, risk, test=None: F.max_by(F.when(test, F.col("policy")) if test is not None else F.col("policy"), F.when(test if test is not None else F.lit(True), F.struct(F.col(f1), (-F.col(risk)).alias("r"), F.col("policy"))))
    margin = F.col("policy").startswith("agency_margin_tau_")
    own = lambda p, c: F.max(F.when(F.col("policy") == p, F.col(c)))
    return aggregate.groupBy("dataset_id", "split_family").agg(
        best("macro_f1", "risk_coverage_auc").alias("best_overall"),
        best("active_macro_f1", "active_risk_coverage_auc").alias("best_active"),
        best("macro_f1", "risk_coverage_auc", margin).alias("best_agency"),
        F.max(F.when(margin, F.col("macro_f1"))).alias("best_agency_macro_f1"),
        F.max(F.when(margin, F.col("active_macro_f1"))).alias("best_agency_active_macro_f1"),
        own("user_only", "macro_f1").alias("user_macro_f1"),
        own("assist_only", "macro_f1").alias("assist_macro_f1"),
        F.count_distinct("policy").alias("n_policies"),
    )


def readiness_checks(observations: DataFrame, floor: float = 0.2, active_floor: float = 0.45) -> DataFrame:
    """check, passed, critical: named rules over the best rows."""
    row = observations.agg(
        F.bool_and(F.col("assist_macro_f1") > F.col("user_macro_f1")).alias("multimodal_direction"),
        (F.max("best_agency_macro_f1") >= floor).alias("performance_floor"),
        (F.max("best_agency_active_macro_f1") >= active_floor).alias("active_floor"),
        F.bool_and(F.col("best_agency_macro_f1") > F.col("user_macro_f1")).alias("agency_direction"),
    )
    rules = [("multimodal_direction", True), ("performance_floor", True), ("active_floor", True), ("agency_direction", False)]
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(False)).alias("passed"), F.lit(c).alias("critical")) for n, c in rules])).alias("x")).select("x.*")


def anchor_checks(observations: DataFrame, pairwise: DataFrame, main: str, external: list[str], exclusions: DataFrame, expected: str, manifests: DataFrame | None = None, floor: float = 0.2, active_floor: float = 0.45) -> DataFrame:
    """check, passed, critical: the readiness of a main dataset and the external ones.

    exclusions: one column of matched ids, of which `expected` must be one. Rules on
    observations (best_policy_rows()) or manifests (matches_config) are left out where
    there are no rows for them. The families that a tau must cover are those with a
    rejected row.
    """
    sure = lambda c: F.coalesce(c, F.lit(False))
    m, e = F.col("dataset_id") == main, F.col("dataset_id").isin(*external)
    margin = F.col("best_agency_macro_f1")
    seen = observations.agg(
        F.bool_and(F.when(m, sure(F.col("assist_macro_f1") > F.col("user_macro_f1")))).alias("multimodal_direction"),
        F.when(F.count_if(m) > 0, sure(F.max(F.when(m, margin)) >= floor)).alias("performance_floor"),
        F.when(F.count_if(m) > 0, sure(F.max(F.when(m, F.col("best_agency_active_macro_f1"))) >= active_floor)).alias("active_floor"),
        F.bool_and(F.when(e, sure(margin > F.col("user_macro_f1")))).alias("external_direction"),
    )
    rows = pairwise.where((F.col("dataset_id") == main) & F.col("metric").isin(*PRIMARY) & F.col("holm_reject"))
    families = rows.agg(F.count_distinct("split_family").alias("all"))
    single = [
        (exclusions.agg(sure(F.bool_or(F.col(exclusions.columns[0]) == expected)).alias("passed")), "exclusion_matched", True),
        (qualifying_taus(rows, families).agg((F.count(F.lit(1)) > 0).alias("passed")), "primary_significance", True),
    ]
    if manifests is not None:
        single.append((manifests.agg(F.bool_and(sure(F.col("matches_config"))).alias("passed")), "manifest_alignment", False))
    rules = [("multimodal_direction", True), ("performance_floor", True), ("active_floor", True), ("external_direction", False)]
    out = seen.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("passed"), F.lit(c).alias("critical")) for n, c in rules])).alias("x")).select("x.*")
    for df, name, critical in single:
        out = out.unionByName(df.select(F.lit(name).alias("check"), "passed", F.lit(critical).alias("critical")))
    return out.where("passed is not null")


def overall_readiness(checks: DataFrame) -> DataFrame:
    return checks.agg(F.when(F.bool_and(F.col("passed") | ~F.col("critical")), "provisionally_ready").otherwise("not_ready").alias("status"))


def config_alignment(manifest: DataFrame, config: DataFrame, key: str, fields: list[str]) -> DataFrame:
    same = F.lit(True)
    c = config.select(key, *[F.col(f).alias(f"config_{f}") for f in fields])
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"config_{f}"))
    return manifest.join(c, key, "left").withColumn("matches_config", same)


def _manifest_rules(kind: str) -> dict[str, Column]:
    """What a manifest of a kind must not be: rule, and the condition that breaks it."""
    c = F.col
    blank = lambda n: F.coalesce(F.trim(c(n)) == "", F.lit(True))
    under = lambda n, least: F.coalesce(c(n) < least, F.lit(True))
    no_list = lambda n: F.coalesce(F.size(n) < 1, F.lit(True))
    blanks_in = lambda n: F.coalesce(F.exists(n, lambda x: F.coalesce(F.trim(x) == "", F.lit(True))), F.lit(True))
    unmarked = lambda n: ~F.coalesce(c(n).endswith("_SUCCESS"), F.lit(False))
    rules = {f"{n} is blank": blank(n) for n in ("dataset", "prepared_root")}
    if kind == "prepared":
        shape = lambda n: F.coalesce((F.size(n) != 2) | F.exists(n, lambda x: x < 0), F.lit(True))
        rules |= {"success_file is no marker": unmarked("success_file"), "required_files is empty": no_list("required_files"), "metadata_columns is empty": no_list("metadata_columns"), "n_rows is below 0": under("n_rows", 0), "label_vocab_size is below 1": under("label_vocab_size", 1)}
        for n in ("user_feature_shape", "assist_feature_shape"):
            rules |= {f"{n} has not two sizes": shape(n), f"{n} has other rows": ~F.coalesce(F.try_element_at(n, F.lit(1)) == c("n_rows"), F.lit(False))}
        return rules | {"has_sequence_payloads differs from the keys": F.coalesce(c("has_sequence_payloads") != (F.size("sequence_payload_keys") > 0), F.lit(True))}
    rules |= {f"{n} is blank": blank(n) for n in ("user_model", "assist_model")}
    if kind == "benchmark":
        rules |= {f"{n} holds a blank": blanks_in(n) for n in ("assist_context_modes", "split_family_allowlist", "split_id_allowlist")}
        roles, sources = F.array_sort(F.array_distinct("available_sequence_payload_roles")), F.array_sort(F.map_keys("sequence_payload_sources"))
        return rules | {"prepared_success_file is no marker": unmarked("prepared_success_file"), "sources differ from roles": ~F.coalesce(roles == sources, F.lit(False)), "max_splits_per_family is below 1": F.coalesce(c("max_splits_per_family") < 1, F.lit(False)), "n_rows is below 0": under("n_rows", 0)}
    if kind == "publication":
        counts = {f"{n} is below 1": under(n, 1) for n in ("trace_count", "decision_count", "pairwise_repeats")}
        return rules | counts | {"split_families is empty": no_list("split_families"), "split_families repeat": F.coalesce(F.size(F.array_distinct("split_families")) < F.size("split_families"), F.lit(False)), "fewer decisions than traces": F.coalesce(c("decision_count") < c("trace_count"), F.lit(False))}
    raise ValueError(f"unknown kind of manifest: {kind}")


#: Columns of each kind of manifest, as read from JSON; a field of another type is null, and so broken.
MANIFESTS = {
    "prepared": "dataset string, prepared_root string, success_file string, required_files array<string>, metadata_columns array<string>, n_rows long, label_vocab_size long, user_feature_shape array<long>, assist_feature_shape array<long>, has_sequence_payloads boolean, sequence_payload_keys array<string>",
    "benchmark": "dataset string, prepared_root string, user_model string, assist_model string, prepared_success_file string, assist_context_modes array<string>, split_family_allowlist array<string>, split_id_allowlist array<string>, available_sequence_payload_roles array<string>, sequence_payload_sources map<string,string>, max_splits_per_family long, n_rows long",
    "publication": "dataset string, prepared_root string, user_model string, assist_model string, trace_count long, decision_count long, pairwise_repeats long, split_families array<string>",
}


def read_manifests(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """path and the fields of every JSON manifest (one object a file) of a kind below path; what isn't JSON has null fields."""
    if kind not in MANIFESTS:
        raise ValueError(f"unknown kind of manifest: {kind}")
    text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return text.select(F.input_file_name().alias("path"), F.from_json("value", MANIFESTS[kind]).alias("m")).select("path", "m.*")


def manifest_violations(manifests: DataFrame, kind: str, key: str = "dataset") -> DataFrame:
    """key, rule: one row per rule that a manifest of this kind (prepared, benchmark, publication) breaks.

    A field that is null is broken; one that is no column is an error.
    """
    broken = F.array_compact(F.array(*[F.when(test, name) for name, test in _manifest_rules(kind).items()]))
    return manifests.select(key, F.explode(broken).alias("rule"))


def phase_fusion_anchor(traces: DataFrame, at_s: float = 0.2) -> DataFrame:
    """Early assist times final user posterior per episode; means of split means, in percent."""
    row = F.struct("p_user", "p_assist", "label")
    e = traces.groupBy("split_id", "episode_id").agg(F.min_by(row, F.struct(F.abs(F.col("prefix_time_s") - at_s), F.col("prefix_time_s"))).alias("early"), F.max_by(row, F.col("prefix_time_s")).alias("final"))
    fused = F.zip_with("early.p_assist", "final.p_user", lambda x, y: x * y)
    fused = F.when(F.aggregate(fused, F.lit(0.0), lambda s, x: s + x) > 0, normalize(fused)).otherwise(F.col("final.p_user"))
    hit = lambda p, r: (argmax(p) == F.col(f"{r}.label")).cast("double")
    s = e.select("split_id", hit(F.col("final.p_user"), "final").alias("u"), hit(fused, "final").alias("f"), hit(F.col("early.p_assist"), "early").alias("a")).groupBy("split_id").agg(*[F.avg(c).alias(c) for c in "ufa"], F.count(F.lit(1)).alias("n"))
    return s.agg(F.sum("n").alias("n_trials"), F.count(F.lit(1)).alias("n_splits"), (F.avg("u") * 100).alias("user_percent"), (F.avg("f") * 100).alias("integrated_percent"), (F.avg("a") * 100).alias("early_percent"), (F.avg(F.col("f") - F.col("u")) * 100).alias("gain_points"))


def group_gain_anchor(traces: DataFrame) -> DataFrame:
    """Assist over user accuracy on last rows: by split and subject, then subject, then group; population deviation."""
    w = Window.partitionBy("split_id", "episode_id").orderBy(F.desc("prefix_time_s"), F.desc("event_id"))
    last = traces.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    hit = lambda p: F.avg((argmax(F.col(p)) == F.col("label")).cast("double"))
    s = last.groupBy("split_id", "group", "subject_id").agg(hit("p_user").alias("u"), hit("p_assist").alias("a")).withColumn("gain", (F.col("a") - F.col("u")) * 100)
    subject = s.groupBy("group", "subject_id").agg(*[F.avg(c).alias(c) for c in ("u", "a", "gain")])
    return subject.groupBy("group").agg(F.count(F.lit(1)).alias("n_subjects"), (F.avg("u") * 100).alias("user_percent"), (F.avg("a") * 100).alias("assist_percent"), F.avg("gain").alias("gain_points"), F.stddev_pop("gain").alias("gain_std"))


def comparability(comparisons: DataFrame) -> DataFrame:
    """Adds comparability, claim_blocked and blocking_fields to comparison rows; blank criteria are unknown."""
    df = comparisons
    for c in CRITERIA:
        token = F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
        df = df.withColumn(c, F.when(token == "", "unknown").otherwise(token))
    exact = F.lit(True)
    for c in CRITERIA[:-1]:
        exact = exact & (F.col(c) == "exact")
    near = ("exact", "related")
    level = (
        F.when(F.lower("role") == "boundary", "boundary")
        .when(F.lower("role") == "context", "contextual")
        .when(exact & F.col("metric").isin("exact", "convertible"), "direct")
        .when((F.col("dataset") == "exact") & F.col("task_family").isin(*near) & F.col("population").isin(*near), "partial")
        .otherwise("not_comparable")
    )
    blocking = F.array_join(F.filter(F.array(*[F.when(~F.col(c).isin("exact", "convertible"), c) for c in CRITERIA]), lambda x: x.isNotNull()), "|")
    return df.withColumn("comparability", level).withColumn("claim_blocked", F.col("comparability") != "direct").withColumn("blocking_fields", blocking)


def comparability_summary(rows: DataFrame) -> DataFrame:
    levels = ("direct", "partial", "not_comparable", "contextual", "boundary")
    return rows.groupBy("target_id").agg(*[F.count_if(F.col("comparability") == x).alias(f"n_{x}") for x in levels])


def target_status(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """targets: target_id, local (null: no metric), observed, higher, eligible, stats_ready; rows: comparability rows with value."""
    value = F.when(F.col("comparability") == "direct", F.col("value"))
    by = rows.groupBy("target_id").agg(F.count_if(F.col("comparability") == "direct").alias("n_direct"), F.max(value).alias("hi"), F.min(value).alias("lo"))
    t = targets.join(by, "target_id", "left").withColumn("n_direct", F.coalesce("n_direct", F.lit(0))).withColumn("best", F.when(F.col("higher"), F.col("hi")).otherwise(F.col("lo")))
    wins = F.when(F.col("higher"), F.col("local") > F.col("best")).otherwise(F.col("local") < F.col("best"))
    status = (
        F.when(~F.col("observed"), "missing_local_result")
        .when(F.col("local").isNull(), "missing_local_metric")
        .when(F.col("n_direct") == 0, "not_established_no_direct_anchor")
        .when(F.col("best").isNull(), "not_established_non_numeric_direct_anchor")
        .when(~wins, "not_established_direct_anchor_not_beaten")
        .when(~F.col("eligible"), "candidate_direct_numeric_win_benchmark_only")
        .when(~F.col("stats_ready"), "candidate_direct_numeric_win_pending_stats")
        .otherwise("candidate_direct_sota")
    )
    return t.select("target_id", "local", "best", "n_direct", "eligible", status.alias("status")).withColumn("claim_ready", F.col("status") == "candidate_direct_sota")


def overall_status(results: DataFrame, readiness: str) -> DataFrame:
    """One status over all primary targets."""
    e = F.col("eligible")
    has = lambda s: F.coalesce(F.bool_or(e & (F.col("status") == s)), F.lit(False))
    status = (
        F.when(F.lit(readiness != "provisionally_ready"), "blocked_benchmark_not_ready")
        .when(F.coalesce(F.bool_or(F.col("status").startswith("missing_local")), F.lit(False)), "blocked_primary_evidence_incomplete")
        .when(~F.coalesce(F.bool_or(e), F.lit(False)), "claim_safe_benchmark_only")
        .when(has("candidate_direct_numeric_win_pending_stats"), "direct_numeric_win_pending_stats")
        .when(has("candidate_direct_sota") & F.bool_and(~e | F.col("claim_ready")), "direct_comparable_sota_supported")
        .when(has("not_established_direct_anchor_not_beaten"), "claim_safe_non_sota")
        .otherwise("claim_safe_benchmark_only")
    )
    return results.agg(status.alias("status"))


def chart_tables(aggregate: DataFrame, value: str) -> DataFrame:
    """family and tau of each policy row, and the mean of a value over them."""
    return aggregate.select("dataset_id", "split_family", policy_family(F.col("policy")).alias("family"), tau_token(F.col("policy")).alias("tau"), F.col(value).alias("v")).groupBy("dataset_id", "split_family", "family", "tau").agg(F.avg("v").alias(f"mean_{value}"), F.count(F.lit(1)).alias("n"))


def signed_benefit(pairwise: DataFrame) -> DataFrame:
    """Adds benefit, benefit_low, benefit_high: above 0 is better, so the ends swap where lower is better."""
    lower = F.col("metric").isin(*LOWER)
    signed = lambda own, other: F.when(lower, -F.col(other)).otherwise(F.col(own))
    return pairwise.withColumns({"benefit": signed("estimate", "estimate"), "benefit_low": signed("ci_low", "ci_high"), "benefit_high": signed("ci_high", "ci_low")})


def match_counts(by_tau: DataFrame, selection: DataFrame) -> DataFrame:
    """Required rows of instability_by_tau() with exact_n of total_n units that met the budget exactly."""
    keys = ["dataset_id", "split_family", "tau"]
    n = selection.groupBy(*keys).agg(F.count_if(F.coalesce(F.col("exact_budget_match"), F.lit(False))).alias("exact_n"), F.count(F.lit(1)).alias("total_n"))
    return by_tau.where("scope = 'required'").join(n, keys, "left")


def synthetic_grid(spark: SparkSession, subjects: int = 12, sessions: int = 2, days: int = 2, trials: int = 30) -> DataFrame:
    """subjects x sessions x days x trials; every fourth subject is in the other group."""
    n = subjects * sessions * days * trials
    i = F.col("id")
    return spark.range(n).select(i.alias("row_id"), (i / (sessions * days * trials)).cast("int").alias("subject"), ((i / (days * trials)).cast("int") % sessions).alias("session"), ((i / trials).cast("int") % days).alias("day"), (i % trials).cast("int").alias("trial")).withColumn("group", F.when(F.col("subject") % 4 == 3, "amputee").otherwise("able_bodied"))


def synthetic_traces(grid: DataFrame, k: int = 5, seed: int = 7) -> DataFrame:
    """Noisy posteriors around a label, by hashes: the other group is noisier, 18 in 100 assist vectors point elsewhere."""
    u = lambda i, tag: F.pmod(F.xxhash64("row_id", i, F.lit(tag), F.lit(seed)), F.lit(1000)) / 1000.0
    label = F.pmod(F.xxhash64("row_id", F.lit("label"), F.lit(seed)), F.lit(k)).cast("int")
    wrong = F.pmod(F.xxhash64("row_id", F.lit("wrong"), F.lit(seed)), F.lit(100)) < 18
    other = F.pmod(label + 1 + F.pmod(F.xxhash64("row_id", F.lit("other"), F.lit(seed)), F.lit(k - 1)).cast("int"), F.lit(k))
    g = grid.withColumn("label", label).withColumn("_aim", F.when(wrong, other).otherwise(label))
    index = F.sequence(F.lit(0), F.lit(k - 1))
    noisy = lambda aim, lift, tag: normalize(F.transform(index, lambda i: u(i, tag) + F.when(i == aim, lift).otherwise(0.05)))
    penalty = F.when(F.col("group") == "amputee", 0.6).otherwise(1.0)
    return g.withColumn("p_user", noisy(F.col("label"), penalty * 1.0, "u")).withColumn("p_assist", noisy(F.col("_aim"), F.lit(1.6), "a")).drop("_aim")
