"""Metrics of decisions by inferential unit.

unit_metrics() makes one pass: rows are shuffled once by unit and sorted once by
coverage (large tables by ranges of both, so that no unit is bound to one task);
running hits, class counts, bins and means then meet in one aggregation. Metrics that
a query doesn't read are pruned from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.arrays import EPS, clip_normalize
from heddle.sources.store import stored

UNIT = ["dataset_id", "split_id", "policy", "subject_id", "session", "day"]


def class_count(decisions: DataFrame) -> int:
    """The length of the probability vectors, which is K in all metrics over classes."""
    row = decisions.select(F.size("probs").alias("k")).where("k > 0").first()
    return row["k"] if row else 1


def in_classes(column: str, classes: int) -> Column:
    """The column, with an error where it isn't one of the classes; null stays null."""
    c = F.col(column)
    return F.when((c < 0) | (c >= classes), F.raise_error(F.concat(F.lit(f"{column} beyond {classes} classes: "), c.cast("string"))).cast("int")).otherwise(c)


def class_metrics(df: DataFrame, unit: list[str], classes: int | None = None, rest_label: int | None = None, prefix: str = "") -> DataFrame:
    """Balanced accuracy and macro-F1 over all classes (absent ones count 0).

    rest_label: only rows of other labels, and the mean over the other classes.
    classes: the length of the vectors if not given; a label or action beyond is an error.
    """
    classes = classes or class_count(df)
    df = df.withColumns({c: in_classes(c, classes) for c in ("label", "selected_action")})
    k = classes if rest_label is None else classes - 1
    if rest_label is not None:
        df = df.where(F.col("label") != rest_label)
    hit = (F.col("selected_action") == F.col("label")).cast("long")
    # each row counts once for its true class and once for its chosen one
    ends = df.select(*unit, F.explode(F.array(F.struct(F.col("label").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), hit.alias("tp")), F.struct(F.col("selected_action").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).cast("long").alias("tp")))).alias("e"))
    if rest_label is not None:
        ends = ends.where(F.col("e.c") != rest_label)
    by = ends.groupBy(*unit, "e.c").agg(F.sum("e.t").alias("t"), F.sum("e.p").alias("p"), F.sum("e.tp").alias("tp"))
    recall = F.when(F.col("t") > 0, F.col("tp") / F.col("t")).otherwise(0.0)
    f1 = 2 * F.col("tp") / (F.col("t") + F.col("p"))
    return by.groupBy(*unit).agg((F.sum(recall) / k).alias(f"{prefix}balanced_accuracy"), (F.sum(f1) / k).alias(f"{prefix}macro_f1"), F.sum("t").alias(f"{prefix}n_class_rows"))


def brier(probs: Column, label: Column) -> Column:
    q = clip_normalize(probs)
    index = F.sequence(F.lit(0), F.size(probs) - 1)
    return F.aggregate(F.zip_with(q, index, lambda x, i: F.pow(x - (i == label).cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x)


def nll(probs: Column, label: Column) -> Column:
    return -F.log(F.greatest(F.element_at(clip_normalize(probs), label + 1), F.lit(EPS)))


def reliability_table(df: DataFrame, unit: list[str], bins: int = 15) -> DataFrame:
    """Rows, accuracy and confidence by (low, high] bin of the largest probability; confidence 0 is in none."""
    conf = F.array_max(clip_normalize(F.col("probs")))
    bin_ = F.least(F.ceil(F.round(conf * bins, 9)), F.lit(bins)).cast("int")
    return df.withColumn("conf", conf).withColumn("bin", bin_).where("bin >= 1").groupBy(*unit, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("conf").alias("confidence"))


def ece(df: DataFrame, unit: list[str], bins: int = 15) -> DataFrame:
    t = reliability_table(df, unit, bins)
    return t.groupBy(*unit).agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


#: Estimated bytes of decisions beyond which units are sorted in parts.
WHOLE_BYTES = 1 << 30


def ordered_running(d: DataFrame, unit: list[str], key: str, sums: dict[str, Column], split: bool | None = None) -> DataFrame:
    """d with running sums in each unit, by falling coverage, then by key.

    A table whose estimated size is below WHOLE_BYTES is sorted by unit, no task being
    longer than the table. Otherwise (or with split) rows are dealt by ranges of
    (unit, coverage, key) and stored; each range adds up its own, what the ranges before
    hold of the unit is added to that, and a unit may lie in any number of tasks.
    """
    order = [F.desc("coverage"), F.asc(key)]
    if split is None:
        split = int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > WHOLE_BYTES
    if not split:
        w = Window.partitionBy(*unit).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return d.withColumns({n: F.sum(e).over(w) for n, e in sums.items()})
    named = d.withColumns({"_unit": F.to_json(F.struct(*unit)), **{f"_x_{n}": e for n, e in sums.items()}})
    cut = stored(named.repartitionByRange("_unit", *order).withColumn("_part", F.spark_partition_id()), "ranges")
    parts = cut.groupBy("_unit", "_part").agg(*[F.sum(f"_x_{n}").alias(f"_s_{n}") for n in sums])
    before = Window.partitionBy("_unit").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_unit", "_part", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    w = Window.partitionBy("_unit", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(parts, ["_unit", "_part"]).withColumns({n: F.col(f"_b_{n}") + F.sum(f"_x_{n}").over(w) for n in sums})
    return out.drop("_unit", "_part", *[f"_x_{n}" for n in sums], *[f"_b_{n}" for n in sums])


def risk_coverage(df: DataFrame, unit: list[str], key: str, name: str = "risk_coverage_auc", split: bool | None = None) -> DataFrame:
    """Mean over k of the error among the k most confident; confidences equal to 12 digits go in row-key order."""
    d = df.select(*unit, key, F.round("coverage", 12).alias("coverage"), F.col("correct").cast("long").alias("correct"))
    r = ordered_running(d, unit, key, {"hits": F.col("correct"), "rank": F.lit(1)}, split)
    return r.groupBy(*unit).agg(F.avg(1 - F.col("hits") / F.col("rank")).alias(name))


def rates(df: DataFrame, unit: list[str]) -> DataFrame:
    return df.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg(F.col("intervene").cast("double")).alias("intervention_rate"),
        F.avg("expected_ali").alias("mean_ali"),
        F.median("decision_time_ms").alias("median_decision_time_ms"),
        F.avg(brier(F.col("probs"), F.col("label"))).alias("brier"),
        F.avg(nll(F.col("probs"), F.col("label"))).alias("nll"),
    )


def unit_metrics(decisions: DataFrame, unit: list[str] | None = None, classes: int | None = None, rest_label: int | None = 0, key: str = "event_id", bins: int = 15, split: bool | None = None) -> DataFrame:
    """All metrics of every unit; the active ones leave out the rest label.

    classes: the length of the probability vectors if not given; a label or action
    beyond is an error. Without active rows the active metrics are 0. split: see
    ordered_running().
    """
    unit = unit or UNIT
    classes = classes or class_count(decisions)
    decisions = decisions.withColumns({c: in_classes(c, classes) for c in ("label", "selected_action")})
    x, label = F.col("selected_action"), F.col("label")
    conf = F.array_max(clip_normalize(F.col("probs")))
    active = (label != rest_label) if rest_label is not None else F.lit(True)
    d = decisions.select(
        *unit, key, label.alias("label"), x.alias("selected_action"), F.col("correct").cast("long").alias("correct"), F.col("intervene").cast("double").alias("intervene"), "expected_ali", "decision_time_ms",
        F.round("coverage", 12).alias("coverage"), active.alias("active"), brier(F.col("probs"), label).alias("brier"), nll(F.col("probs"), label).alias("nll"), conf.alias("conf"),
    )
    on = F.col("active")
    sums = {"hits": F.col("correct"), "rank": F.lit(1), "active_hits": F.when(on, F.col("correct")).otherwise(0), "active_rank": on.cast("long")}
    d = ordered_running(d, unit, key, sums, split)
    d = d.withColumn("bin", F.least(F.ceil(F.round(F.col("conf") * bins, 9)), F.lit(bins)).cast("int"))
    count = lambda test: F.sum(test.cast("long"))
    chosen = [k for k in range(classes) if k != rest_label]
    counts = {f"{n}{k}": count(t) for k in range(classes) for n, t in (("t", label == k), ("p", x == k), ("tp", (label == k) & (x == k)), ("ap", on & (x == k)))}
    gaps = {f"bin{b}": F.sum(F.when(F.col("bin") == b, F.col("correct") - F.col("conf"))) for b in range(1, bins + 1)}
    rows = d.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg("intervene").alias("intervention_rate"),
        F.avg("expected_ali").alias("mean_ali"),
        F.median("decision_time_ms").alias("median_decision_time_ms"),
        F.avg("brier").alias("brier"),
        F.avg("nll").alias("nll"),
        F.avg(1 - F.col("hits") / F.col("rank")).alias("risk_coverage_auc"),
        F.avg(F.when(on, 1 - F.col("active_hits") / F.col("active_rank"))).alias("active_risk_coverage_auc"),
        count(on).alias("n_active"),
        count(F.col("bin") >= 1).alias("n_binned"),
        *[e.alias(n) for n, e in (counts | gaps).items()],
    )
    c = lambda n, k: F.col(f"{n}{k}")
    recall = lambda k: F.when(c("t", k) > 0, c("tp", k) / c("t", k)).otherwise(0.0)
    f1 = lambda k, p: F.when(c("t", k) + c(p, k) > 0, 2 * c("tp", k) / (c("t", k) + c(p, k))).otherwise(0.0)
    mean = lambda values: sum(values[1:], values[0]) / len(values)
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    out = rows.select(
        *unit, "n", "accuracy", "intervention_rate", "mean_ali", "median_decision_time_ms", "brier", "nll",
        (sum([F.abs(zero(F.col(b))) for b in gaps][1:], F.abs(zero(F.col("bin1")))) / F.col("n_binned")).alias("ece"),
        mean([recall(k) for k in range(classes)]).alias("balanced_accuracy"),
        mean([f1(k, "p") for k in range(classes)]).alias("macro_f1"),
        "risk_coverage_auc",
        mean([recall(k) for k in chosen]).alias("active_balanced_accuracy"),
        mean([f1(k, "ap") for k in chosen]).alias("active_macro_f1"),
        "n_active",
        zero(F.col("active_risk_coverage_auc")).alias("active_risk_coverage_auc"),
    )
    return out.withColumn("split_family", F.split_part("split_id", F.lit("|"), F.lit(1))) if "split_id" in unit else out


METRICS = ["accuracy", "balanced_accuracy", "macro_f1", "active_macro_f1", "brier", "nll", "ece", "risk_coverage_auc", "active_risk_coverage_auc", "intervention_rate", "mean_ali", "median_decision_time_ms"]


def family_aggregate(units: DataFrame, two_stage: bool = True, metrics: list[str] | None = None) -> DataFrame:
    """Means by split family and policy: of split means (two_stage), or of units; n is summed."""
    metrics = metrics or METRICS
    means = [F.avg(m).alias(m) for m in metrics]
    if two_stage:
        units = units.groupBy("dataset_id", "split_family", "split_id", "policy").agg(*means, F.sum("n").alias("n"))
    return units.groupBy("dataset_id", "split_family", "policy").agg(*means, F.sum("n").alias("n"))
