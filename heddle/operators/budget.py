"""Comparison at equal intervention budget: matched gates, interpolated curves, exact thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.arrays import argmax
from heddle.operators import policies
from heddle.operators.ordered import exact_quantiles, running_sums

LOWER_IS_BETTER = ("active_risk_coverage_auc", "risk_coverage_auc", "ece", "brier", "nll", "mean_ali", "median_earliest_safe_s", "median_earliest_stable_safe_s")


def match_key(rate: Column, target: Column, threshold: Column) -> Column:
    """Order of candidates: least gap, then not above the target, then the larger threshold."""
    return F.struct(F.abs(rate - target).alias("gap"), (rate > target).cast("int").alias("over"), (-threshold).alias("neg"))


def match_threshold(candidates: DataFrame, by: list[str]) -> DataFrame:
    """candidates: by, threshold, rate, target -> the chosen threshold and its rate for each group."""
    best = F.min_by(F.struct("threshold", "rate"), match_key(F.col("rate"), F.col("target"), F.col("threshold")))
    return candidates.groupBy(*by).agg(best.alias("b"), F.first("target").alias("target")).select(*by, "b.threshold", "b.rate", "target")


def candidate_rates(traces: DataFrame, by: list[str], disagree_only: bool = False) -> DataFrame:
    """by, threshold, rate: the share of rows at or above each distinct assist confidence, and at 0 and 1.01.

    Counts by distinct confidence come first; their running sums go over windows of
    bounded size, whatever the scope.
    """
    t = traces.select(*by, F.array_max("p_assist").alias("threshold"), (argmax(F.col("p_assist")) != argmax(F.col("p_user"))).cast("long").alias("x"))
    hits = F.sum("x") if disagree_only else F.count(F.lit(1))
    counts = t.groupBy(*by, "threshold").agg(hits.alias("c"), F.count(F.lit(1)).alias("rows"))
    ends = counts.groupBy(*by).agg(F.sum("rows").alias("n"))
    extra = ends.select(*by, F.explode(F.array(F.lit(0.0), F.lit(1.01))).alias("threshold"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("rows"))
    every = counts.select(*by, "threshold", "c", "rows").union(extra).groupBy(*by, "threshold").agg(F.sum("c").alias("c"), F.sum("rows").alias("rows"))
    run = running_sums(every, by, "threshold", ["c", "rows"])
    return run.select(*by, "threshold", ((F.col("c_all") - F.col("c_upto") + F.col("c")) / F.col("rows_all")).alias("rate"), F.col("rows_all").alias("n"))


def margin_rates(traces: DataFrame, by: list[str], taus: tuple[float, ...]) -> DataFrame:
    """by, tau, target: the margin policy's intervention rate at each budget."""
    p, traces = policies.Staged(), policies.stage(traces)
    moved = F.array(*[F.struct(F.lit(t).alias("tau"), (policies.margin_budget(p, t)["selected_action"] != p.u).cast("double").alias("moved")) for t in taus])
    return traces.select(*by, F.explode(moved).alias("m")).groupBy(*by, "m.tau").agg(F.avg("m.moved").alias("target"))


def target_rate_threshold(traces: DataFrame, by: list[str], targets: DataFrame) -> DataFrame:
    """For each target (by, tau, target) the confidence whose gate changes the action as often.

    Adds threshold, rate, gap, n_thresholds, n (traces), disagree (traces whose actions
    differ) and max_rate, the largest rate that any threshold reaches.
    """
    cand = candidate_rates(traces, by, disagree_only=True)
    joined = cand.drop("n").join(targets, by) if by else cand.drop("n").crossJoin(F.broadcast(targets))
    chosen = match_threshold(joined, [*by, "tau"]).withColumn("gap", F.abs(F.col("rate") - F.col("target")))
    most = cand.groupBy(*by).agg(F.count(F.lit(1)).alias("n_thresholds"), F.first("n").alias("n"), F.max("rate").alias("max_rate"))
    most = most.withColumn("disagree", F.round(F.col("max_rate") * F.col("n")).cast("long"))
    return chosen.join(most, by) if by else chosen.crossJoin(F.broadcast(most))


def rate_matched_gate(traces: DataFrame, taus: tuple[float, ...] = policies.TAUS, scope: tuple[str, ...] = ("split_id",)) -> DataFrame:
    """scope, tau, threshold, target and matched rate, gap: one confidence gate per scope and budget."""
    by = list(scope)
    cand = candidate_rates(traces, by).drop("n")
    target = margin_rates(traces, by, taus)
    joined = cand.join(target, by) if by else cand.crossJoin(F.broadcast(target))
    return match_threshold(joined, [*by, "tau"]).withColumn("gap", F.abs(F.col("rate") - F.col("target")))


def apply_gate(traces: DataFrame, chosen: DataFrame, by: list[str], prefix: str = "plain_conf_threshold_matched_tau_") -> DataFrame:
    """Decisions of the gate at each scope's chosen thresholds (columns by, tau, threshold)."""
    name = F.concat(F.lit(prefix), F.format_string("%.2f", F.col("gate_tau")))
    picked = chosen.select(*by, F.col("tau").alias("gate_tau"), F.col("threshold").alias("gate_threshold"))
    joined = traces.join(picked, by) if by else traces.crossJoin(F.broadcast(picked))
    grid = F.array(policies.conf_gate(policies.Staged(), F.col("gate_threshold"), F.col("gate_tau"), name))
    return policies.expand(joined, grid).drop("gate_tau", "gate_threshold")


def threshold_bank(traces: DataFrame, size: int = 201) -> list[float]:
    """At most size + 2 thresholds: the distinct assist confidences, or linear quantiles of them, and 0 and 1.01."""
    conf = traces.select(F.array_max("p_assist").alias("c")).persist()  # read by every pass
    few = conf.distinct().limit(size + 1).collect()
    if len(few) > size:
        values = exact_quantiles(conf, [], "c", [k / (size - 1) for k in range(size)])[()]
    else:
        values = [r.c for r in few]
    conf.unpersist()
    return sorted({*values, 0.0, 1.01})


def bank_place(df: DataFrame, value: str, bank: list[float], name: str) -> DataFrame:
    """df with the 0-based place of the largest of the sorted bank's values that isn't above the value (-1: none), by bisection."""
    places, size = F.array(*[F.lit(float(b)) for b in bank]), len(bank)
    out = df.withColumn(name, F.lit(-1))
    step = 1 << (size.bit_length() - 1)
    while step:
        ahead = F.col(name) + step
        out = out.withColumn(name, F.when((ahead < size) & (F.get(places, F.least(ahead, F.lit(size - 1))) <= F.col(value)), ahead).otherwise(F.col(name)))
        step //= 2
    return out


def exact_budget_select(traces: DataFrame, taus: tuple[float, ...], bank: list[float], unit: list[str]) -> DataFrame:
    """Per unit and budget the bank threshold whose gate intervenes as often as the margin policy.

    Each confidence falls to its place in the bank once, so the work is traces plus
    units times bank.
    """
    places = F.array(*map(F.lit, bank))
    t = bank_place(traces.withColumn("_conf", F.array_max("p_assist")), "_conf", bank, "k").select(*unit, "k", (argmax(F.col("p_assist")) != argmax(F.col("p_user"))).cast("long").alias("x"))
    units = t.groupBy(*unit).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("disagree"))
    every = t.groupBy(*unit, "k").agg(F.sum("x").alias("c")).union(units.select(*unit, F.explode(F.sequence(F.lit(0), F.lit(len(bank) - 1))).alias("k"), F.lit(0).cast("long").alias("c"))).groupBy(*unit, "k").agg(F.sum("c").alias("c"))
    w = Window.partitionBy(*unit).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    rates = every.withColumn("hits", F.sum("c").over(w)).join(units, unit).select(*unit, F.element_at(places, F.col("k") + 1).alias("threshold"), (F.col("hits") / F.col("n")).alias("rate"))
    chosen = match_threshold(rates.join(margin_rates(traces, unit, taus), unit), [*unit, "tau"])
    top = rates.groupBy(*unit).agg(F.max("rate").alias("max_rate"))
    gap = F.abs(F.col("rate") - F.col("target"))
    return chosen.join(units, unit).join(top, unit).withColumn("gap", gap).withColumn("exact_match", F.col("gap") <= 1e-12)


def exact_budget_units(traces: DataFrame, selection: DataFrame, unit: list[str], classes: int | None = None, prefix: str = "exact_budget_tau_", key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Unit metrics and earliest times of the gates that selection (unit, tau, threshold) chose for each unit.

    Rows of both carry the unit's own columns among those of metrics.UNIT and timing.UNIT.
    """
    from heddle.operators import metrics, timing

    d = apply_gate(traces, selection, unit, prefix)
    keys = [c for c in metrics.UNIT if c in {"dataset_id", "split_id", "policy"} | set(unit)]
    episodes = timing.earliest_by_episode(d, key)
    per_unit = timing.earliest_by_unit(episodes, [c for c in timing.UNIT if c in keys])
    return metrics.unit_metrics(d, keys, classes, key=key), per_unit


def exact_budget_diagnostics(selection: DataFrame) -> DataFrame:
    family = F.split_part("split_id", F.lit("|"), F.lit(1)).alias("split_family")
    return selection.groupBy(family, "tau").agg(
        F.count(F.lit(1)).alias("n_audit_units"),
        F.avg("gap").alias("mean_abs_gap"),
        F.max("gap").alias("max_abs_gap"),
        F.avg(F.col("exact_match").cast("double")).alias("exact_match_fraction"),
        F.sum(F.col("exact_match").cast("long")).alias("n_exact_match_units"),
        F.avg("threshold").alias("mean_threshold"),
        F.min("threshold").alias("min_threshold"),
        F.max("threshold").alias("max_threshold"),
    )


def policy_pairs(units: DataFrame, left: str = "agency_margin_tau_", right: str = "set_acsa_tau_") -> DataFrame:
    """Pairs of present policies with the same budget token."""
    p = units.select("policy", policies.tau_token(F.col("policy")).alias("tau")).distinct().where("tau is not null")
    a = p.where(F.col("policy").startswith(left)).select("tau", F.col("policy").alias("policy_a"))
    return a.join(p.where(F.col("policy").startswith(right)).select("tau", F.col("policy").alias("policy_b")), "tau")


#: What a unit row and its budget are joined on.
BUDGET_KEYS = ("dataset_id", "split_family", "split_id", "policy", "subject_id", "session", "day")


def attach_budget(units: DataFrame, budgets: DataFrame, keys: Sequence[str] = BUDGET_KEYS) -> DataFrame:
    """Left join of intervention_rate, one to one, on keys as text; duplicate keys on either side and missing budgets raise.

    Null keys are one value. A key that a side lacks is an error.
    """
    for name, df in (("units", units), ("budgets", budgets)):
        absent = [k for k in keys if k not in df.columns]
        if absent:
            raise ValueError(f"{name} lack columns: {absent}")
    text = lambda df: df.select(*[F.coalesce(F.col(k).cast("string"), F.lit("<missing>")).alias(k) for k in keys], *[c for c in df.columns if c not in keys])
    own = text(budgets).groupBy(*keys).agg(F.first("intervention_rate").alias("_rate"), F.count(F.lit(1)).alias("_n"))
    mine = text(units).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    joined = mine.join(own, list(keys), "left")
    fail = lambda what: F.raise_error(F.lit(what)).cast("double")
    checked = F.when(F.col("_n") > 1, fail("duplicate budget keys")).when(F.col("_m") > 1, fail("duplicate unit keys")).when(F.col("_rate").isNull(), fail("missing budget")).otherwise(F.col("_rate"))
    return joined.withColumn("intervention_rate", checked).drop("_n", "_m", "_rate")


def interpolate_curve(curve: DataFrame, targets: DataFrame, by: list[str], allow_extrapolation: bool = False, min_points: int = 2) -> DataFrame:
    """curve: by, budget, value; targets: by, target (and more columns) -> value at the target, gaps and flags.

    The neighbours of the target come from one aggregation over the unit's points.
    """
    points = curve.where("value is not null and budget is not null").groupBy(*by, "budget").agg(F.avg("value").alias("value"))
    pt = F.struct("budget", "value")
    keys = [c for c in targets.columns]
    x, t = F.col("budget"), F.col("target")
    near = targets.join(points, by, "left").groupBy(*keys).agg(
        F.count("budget").alias("n_points"),
        F.min(F.abs(x - t)).alias("nearest_gap"),
        F.max(F.when(x <= t, pt)).alias("lo"),
        F.min(F.when(x >= t, pt)).alias("hi"),
        F.min(F.when(x.isNotNull(), pt)).alias("first"),
        F.max(F.when(x.isNotNull(), pt)).alias("last"),
    )
    outside = F.coalesce(F.col("lo").isNull() | F.col("hi").isNull(), F.lit(True)) & (F.col("n_points") > 0)
    supported = ((F.col("nearest_gap") <= 1e-12) | (F.col("n_points") >= min_points)) & (F.lit(allow_extrapolation) | ~F.col("extrapolated"))
    slope = (F.col("hi.value") - F.col("lo.value")) / (F.col("hi.budget") - F.col("lo.budget"))
    inside = F.when(F.col("hi.budget") == F.col("lo.budget"), F.col("lo.value")).otherwise(F.col("lo.value") + slope * (t - F.col("lo.budget")))
    clamped = F.when(F.col("lo").isNull(), F.col("first.value")).when(F.col("hi").isNull(), F.col("last.value")).otherwise(inside)
    out = near.withColumn("extrapolated", outside).withColumn("supported", F.coalesce(supported, F.lit(False)))
    return out.withColumn("value", F.when(F.col("supported"), clamped)).select(*keys, "value", "nearest_gap", "extrapolated", "supported", "n_points")


def directional(metric: Column, delta: Column) -> Column:
    return F.when(metric.isin(*LOWER_IS_BETTER), -delta).otherwise(delta)


def iso_budget_deltas(units: DataFrame, unit: list[str], metrics: list[str], left: str = "agency_margin_tau_", curve_prefix: str = "plain_conf", pair: str = "set_acsa_tau_") -> DataFrame:
    """Each unit's margin policy against its gates' curve at the same budget, and against the same-tau policy."""
    long = units.unpivot([*unit, "policy", "intervention_rate"], metrics, "metric", "value")
    long = long.groupBy(*unit, "policy", "metric").agg(F.avg("intervention_rate").alias("budget"), F.avg("value").alias("value"))
    token = policies.tau_token(F.col("policy"))
    a = long.where(F.col("policy").startswith(left)).select(*unit, "metric", token.alias("tau"), F.col("budget").alias("target"), F.col("value").alias("agency_value"))
    same = long.where(F.col("policy").startswith(pair)).select(*unit, "metric", token.alias("tau"), F.col("value").alias("same_tau_value"))
    curve = long.where(F.col("policy").startswith(curve_prefix)).select(*unit, "metric", "budget", "value")
    at = interpolate_curve(curve, a.join(curve.select(*unit).distinct(), unit, "left_semi"), [*unit, "metric"])
    out = at.withColumnRenamed("value", "iso_value").join(same, [*unit, "metric", "tau"], "left")
    out = out.withColumn("delta_same_tau", F.col("agency_value") - F.col("same_tau_value")).withColumn("delta_iso_budget", F.col("agency_value") - F.col("iso_value"))
    return out.withColumn("directional_delta", directional(F.col("metric"), F.col("delta_iso_budget")))


def iso_budget_pairwise(deltas: DataFrame) -> DataFrame:
    """Per family, metric and tau: units with and without a delta, support of their curves, gaps, estimate, beneficial; cells without any delta go."""
    family = F.split_part("split_id", F.lit("|"), F.lit(1)).alias("split_family")
    have = F.col("delta_iso_budget").isNotNull()
    return (
        deltas.groupBy(family, "metric", "tau")
        .agg(
            F.count(F.lit(1)).alias("n_units_total"),
            F.count("delta_iso_budget").alias("n_units"),
            F.count_if(~have).alias("n_units_missing_metric"),
            F.sum(F.col("extrapolated").cast("long")).alias("n_extrapolated"),
            F.avg(F.col("extrapolated").cast("double")).alias("extrapolated_fraction"),
            F.count_if(have & F.col("supported")).alias("n_supported"),
            F.count_if(F.col("n_points") == 1).alias("n_singleton"),
            F.avg("n_points").alias("mean_points"),
            F.avg("delta_iso_budget").alias("estimate"),
            F.avg("nearest_gap").alias("mean_nearest_gap"),
            F.max("nearest_gap").alias("max_nearest_gap"),
        )
        .where("n_units > 0")
        .withColumn("beneficial", directional(F.col("metric"), F.col("estimate")) > 0)
    )


def iso_budget_tests(deltas: DataFrame, repeats: int = 2000) -> DataFrame:
    """iso_budget_pairwise() with the interval and p value of each cell's available deltas."""
    from heddle.operators.inference import bootstrap_ci, signflip_p

    cell = ["split_family", "metric", "tau"]
    d = deltas.withColumn("split_family", F.split_part("split_id", F.lit("|"), F.lit(1)))
    ci = bootstrap_ci(d, "delta_iso_budget", cell, repeats).select(*cell, "ci_low", "ci_high")
    return iso_budget_pairwise(deltas).join(ci, cell).join(signflip_p(d, "delta_iso_budget", cell, repeats).drop("n"), cell)
