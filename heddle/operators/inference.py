"""Paired inference over units: resampling, sign flips and step-down correction.

Draws follow from the seed, the group and its values, so results do not depend on how
the rows are partitioned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from heddle.sources.store import stored

SEED = 7411


def paired_matrix(units: DataFrame, unit: list[str], a: str, b: str, metric: str) -> DataFrame:
    """unit, a, b, delta: each unit's means under two policies; a unit with only one of them raises."""
    mean = lambda p: F.avg(F.when(F.col("policy") == p, F.col(metric)))
    m = units.where(F.col("policy").isin(a, b)).groupBy(*unit).agg(mean(a).alias("a"), mean(b).alias("b")).where("a is not null or b is not null")
    half = F.col("a").isNull() | F.col("b").isNull()
    return m.withColumn("delta", F.when(half, F.raise_error(F.lit("incomplete pair")).cast("double")).otherwise(F.col("a") - F.col("b")))


def _numbered(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*by)
    return df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"), (F.row_number().over(w.orderBy(value, *order)) - 1).alias("k"), F.count(F.lit(1)).over(w).alias("n"))


#: Values, or clusters, whose draws a task makes at a time.
BLOCK = 1024


def _share(rng_of, sizes: np.ndarray, block: int, total: np.ndarray) -> np.ndarray:
    """How many of each repeat's `total` draws fall into one block of the given sizes.

    Halves of the blocks are split by binomials down to the block, each from a generator
    of its own, so all tasks agree and each makes a logarithm of the draws only.
    """
    low, high, edges = 0, len(sizes), np.concatenate([[0], np.cumsum(sizes)])
    while high - low > 1:
        middle = (low + high) // 2
        left = rng_of(low, high).binomial(total, (edges[middle] - edges[low]) / (edges[high] - edges[low]))
        if block < middle:
            high, total = middle, left
        else:
            low, total = middle, total - left
    return total


def _generator(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence([int(k) & 0xFFFFFFFFFFFFFFFF for k in key])))


def resampled_means(df: DataFrame, value: str, by: list[str], repeats: int, seed: int = SEED, flips: bool = False) -> DataFrame:
    """by, r, mean, n: for each repeat the mean of n draws of n values; or, with flips, of all values with random signs.

    Equal values are one with a multiplicity; values lie in blocks of about BLOCK, dealt
    by hash. A task draws how often each value of its block counts and adds the block up,
    so what is shuffled are values once and sums per repeat. Draws depend on the seed,
    the group and the values only.
    """
    v = F.col(value).cast("double")
    values = df.select(*by, v.alias("_v")).where("_v is not null and not isnan(_v)").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_m"))
    cells = values.groupBy(*by).agg(F.sum("_m").alias("n"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks"))
    dealt = values.join(cells, by).withColumn("_block", F.pmod(F.xxhash64("_v", F.lit(seed)), F.col("_blocks"))).drop("_blocks")
    sizes = dealt.groupBy(*by, "_block").agg(F.sum("_m").alias("_size")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_block", "_size"))).alias("_sizes"))
    sizes = sizes.select(*by, F.transform("_sizes", lambda x: x["_block"]).alias("_at"), F.transform("_sizes", lambda x: x["_size"]).alias("_sizes"), F.xxhash64(*by, F.lit(seed)).alias("_cell"))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by) + ", n long, _sums array<double>"

    def run(key, rows):
        rows = rows.sort_values("_v")
        first = rows.iloc[0]
        x, m, n, cell, block = rows["_v"].to_numpy(), rows["_m"].to_numpy(np.int64), int(first["n"]), int(first["_cell"]), int(first["_block"])
        rng = _generator(seed, cell, 1, block)
        if flips:
            sums = (2 * rng.binomial(m, 0.5, (repeats, len(m))) - m) @ x
        else:
            split = lambda low, high: _generator(seed, cell, 2, low, high)
            total = _share(split, np.asarray(first["_sizes"], np.int64), int(np.searchsorted(np.asarray(first["_at"]), block)), np.full(repeats, n))
            sums = rng.multinomial(total, m / m.sum()) @ x
        return pd.DataFrame([[*[first[c] for c in by], n, sums]], columns=[*by, "n", "_sums"])

    parts = dealt.join(sizes, by).groupBy(*by, "_block").applyInPandas(run, schema)
    return parts.select(*by, "n", F.posexplode("_sums").alias("r", "s")).groupBy(*by, "r").agg((F.sum("s") / F.first("n")).alias("mean"), F.first("n").alias("n"))


def _interval(means: DataFrame, by: list[str], ci: float) -> DataFrame:
    low = (1 - ci) / 2
    return means.groupBy(*by).agg(F.percentile("mean", F.lit(low)).alias("ci_low"), F.percentile("mean", F.lit(1 - low)).alias("ci_high"))


def bootstrap_ci(df: DataFrame, value: str, by: list[str], repeats: int = 2000, ci: float = 0.95, seed: int = SEED) -> DataFrame:
    """by, estimate, ci_low, ci_high, n: percentile interval of the means of n draws of n values."""
    own = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return own.groupBy(*by).agg(F.avg(value).alias("estimate"), F.count(F.lit(1)).alias("n")).join(_interval(resampled_means(df, value, by, repeats, seed), by, ci), by)


def _dealt(nodes: DataFrame, keys: list[str], child: str, level: int, seed: int) -> DataFrame:
    """A row for each block of about BLOCK children of one parent (keys): the children in order with their sums, and what draws need.

    A parent below the first level whose only child has sums needs no draw, as it has them itself.
    """
    counted = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count("_s").alias("_whole"))
    drawn = counted if level == 0 else counted.where("_n > 1 or _whole = 0")
    block = F.pmod(F.xxhash64(child, F.lit(seed)), F.ceil(F.col("_n") / BLOCK)).alias("_block")
    own = F.array_sort(F.collect_list(F.struct(F.col(child).alias("child"), F.col("_s").alias("s"), F.col("_c").alias("c"))))
    blocks = nodes.join(drawn, keys).select(*keys, child, "_s", "_c", "_n", block).groupBy(*keys, "_block").agg(own.alias("_own"), F.first("_n").alias("_n"))
    sizes = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", F.size("_own").alias("_size")))).alias("_sizes"))
    return blocks.join(sizes, keys).withColumn("_cell", F.xxhash64(*keys, F.lit(seed)))


def _cluster_draws(parents: DataFrame, blocks: DataFrame, by: list[str], keys: list[str], child: str, repeats: int, seed: int) -> DataFrame:
    """Each drawn parent (keys, _times per repeat) draws as many of its children as it has.

    Rows of children that draw on have _times. The others' sums, times how often they are
    drawn, are added up by task: rows with by, _sums and _counts.
    """
    # to all cores: draws are long work per row
    tasks = max(blocks.sparkSession.sparkContext.defaultParallelism, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = blocks.join(parents, keys).repartition(tasks, *keys, "_block")
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys) + f", `{child}` string, _times array<long>, _sums array<double>, _counts array<double>"

    def one(row):
        n, cell, block = row["_n"], row["_cell"], row["_block"]
        split = lambda low, high: _generator(seed, cell, 2, low, high)
        drawn = np.asarray(row["_times"], np.int64) * n
        size = len(row["_own"])
        if len(row["_sizes"]) > 1:
            sizes = np.asarray([x["_size"] for x in row["_sizes"]], np.int64)
            drawn = _share(split, sizes, [x["_block"] for x in row["_sizes"]].index(block), drawn)
        if size == 1:
            return drawn[:, None]
        return _generator(seed, cell, 1, block).multinomial(drawn, np.full(size, 1 / size))

    def run(batches):
        found: dict[tuple, np.ndarray] = {}
        out: list[dict] = []
        for b in batches:
            for at in range(b.num_rows):
                row = {c: b.column(c)[at].as_py() for c in b.schema.names}
                times = one(row)
                whole = np.array([x["s"] is not None for x in row["_own"]])
                sums = np.array([[x["s"] or 0.0, x["c"] or 0.0] for x in row["_own"]])
                cell = tuple(row[c] for c in by)
                # (2, repeats)
                found[cell] = found.get(cell, 0.0) + (times @ np.where(whole[:, None], sums, 0.0)).T
                out += [{**{c: row[c] for c in keys}, child: row["_own"][k]["child"], "_times": times[:, k].tolist(), "_sums": None, "_counts": None} for k in np.flatnonzero(~whole)]
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, typed)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, typed)
        if found:
            yield pa.RecordBatch.from_pylist([{**dict.fromkeys(typed.names), **dict(zip(by, cell, strict=True)), "_sums": x[0].tolist(), "_counts": x[1].tolist()} for cell, x in found.items()], typed)

    typed = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    return rows.mapInArrow(run, schema)


def nested_bootstrap_ci(df: DataFrame, value: str, clusters: list[str], by: list[str], repeats: int = 500, ci: float = 0.95, seed: int = SEED) -> DataFrame:
    """As bootstrap_ci, but clusters are drawn level by level; absent columns are ignored, nulls are one cluster.

    A drawn cluster draws among its own sub-clusters; all rows of a drawn innermost
    cluster count. Rows are added up by innermost cluster first. A cluster with one
    sub-cluster, down to the rows, has the sums of that one and no draw of its own, so what
    is shuffled of it are two numbers; how often a cluster is drawn goes on only to clusters
    that draw among several.
    """
    clusters = [c for c in clusters if c in df.columns]
    text = df.select(*by, *[F.coalesce(F.col(c).cast("string"), F.lit("<missing>")).alias(c) for c in clusters], F.col(value).cast("double").alias("_v"))
    if not clusters:
        clusters, text = ["_all"], text.withColumn("_all", F.lit(""))
    # read by every level
    sums = stored(text.groupBy(*by, *clusters).agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("_s"), F.count("_v").cast("double").alias("_c")), "clusters")
    nodes = [sums]
    for level in range(len(clusters) - 1, 0, -1):
        alone = lambda c: F.when((F.count(F.lit(1)) == 1) & (F.count("_s") == 1), F.first(c)).alias(c)
        nodes.insert(0, nodes[0].groupBy(*by, *clusters[:level]).agg(alone("_s"), alone("_c")))
    times = sums.select(*by).distinct().withColumn("_times", F.array_repeat(F.lit(1).cast("long"), repeats))
    each: DataFrame | None = None
    for level, c in enumerate(clusters):
        keys = [*by, *clusters[:level]]
        drawn = _cluster_draws(times, _dealt(nodes[level], keys, c, level, seed + level), by, keys, c, repeats, seed + level)
        own = drawn.where("_sums is not null").select(*by, "_sums", "_counts")
        each = own if each is None else each.unionByName(own)
        times = drawn.where("_times is not null").select(*keys, c, "_times")
    cells = each.select(*by, F.posexplode(F.arrays_zip("_sums", "_counts")).alias("_r", "x"))
    means = cells.groupBy(*by, "_r").agg(F.try_divide(F.sum("x._sums"), F.sum("x._counts")).alias("mean"))
    return sums.groupBy(*by).agg(F.try_divide(F.sum("_s"), F.sum("_c")).alias("estimate")).join(_interval(means, by, ci), by)


def signflip_p(df: DataFrame, value: str, by: list[str], repeats: int = 2000, seed: int = SEED + 1) -> DataFrame:
    """by, p_value, n: share of sign-flipped means at least as far from 0; one unit alone gives 1."""
    means = resampled_means(df, value, by, repeats, seed, flips=True)
    seen = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by).agg(F.avg(value).alias("observed"))
    p = (F.sum((F.abs("mean") >= F.abs("observed") - 1e-15).cast("long")) + 1) / (repeats + 1)
    return means.join(seen, by).groupBy(*by).agg(F.when(F.first("n") == 1, 1.0).otherwise(p).alias("p_value"), F.first("n").alias("n"))


def exact_signflip_p(df: DataFrame, value: str, by: list[str], most: int = 12) -> DataFrame:
    """by, p_value, exact: the same over all 2^n sign patterns; groups of more than `most` units get signflip_p()'s value, and exact is false."""
    numbered = _numbered(df, value, by, [])
    large = df.where(F.col(value).isNotNull()).join(numbered.where(F.col("n") > most).select(*by).distinct(), by, "left_semi")
    rows = numbered.where(F.col("n") <= most)
    every = rows.withColumn("r", F.explode(F.sequence(F.lit(0), (F.pow(F.lit(2), F.col("n")) - 1).cast("int"))))
    bit = F.pmod(F.floor(F.col("r") / F.pow(F.lit(2), F.col("k"))), F.lit(2))
    means = every.withColumn("s", F.when(bit == 1, F.col("v")).otherwise(-F.col("v"))).groupBy(*by, "r").agg(F.avg("s").alias("m"))
    seen = rows.groupBy(*by).agg(F.avg("v").alias("observed"))
    return means.join(seen, by).groupBy(*by).agg(F.avg((F.abs("m") >= F.abs("observed") - 1e-12).cast("double")).alias("p_value")).withColumn("exact", F.lit(True)).unionByName(signflip_p(large, value, by).select(*by, "p_value", F.lit(False).alias("exact")))


def paired_test(units: DataFrame, unit: list[str], a: str, b: str, metric: str, repeats: int = 2000, seed: int = SEED) -> DataFrame:
    """estimate, ci_low, ci_high, n, p_value of the units' differences; no difference at all is an error."""
    d = paired_ci(units, unit, a, b, metric, repeats, seed)
    flips = signflip_p(paired_matrix(units, unit, a, b, metric).withColumn("g", F.lit(1)), "delta", ["g"], repeats, seed + 1)
    return d.withColumn("g", F.lit(1)).join(flips.drop("n"), "g", "left").drop("g")


def paired_ci(units: DataFrame, unit: list[str], a: str, b: str, metric: str, repeats: int = 2000, seed: int = SEED) -> DataFrame:
    """paired_test() without the p value."""
    d = bootstrap_ci(paired_matrix(units, unit, a, b, metric).withColumn("g", F.lit(1)), "delta", ["g"], repeats, seed=seed)
    filled = d.sparkSession.range(1).select(F.lit(1).alias("g")).join(d, "g", "left")
    none = F.when(F.col("n").isNull(), F.raise_error(F.lit("no paired units")).cast("double")).otherwise(F.col("estimate"))
    return filled.withColumn("estimate", none).drop("g")


def holm_annotate(df: DataFrame, by: list[str], p: str, order: list[str], alpha: float = 0.05) -> DataFrame:
    """Adds holm_rank, n_tests, holm_threshold, holm_reject; ties in p go by `order`."""
    w = Window.partitionBy(*by).orderBy(p, *order)
    out = df.withColumn("holm_rank", F.row_number().over(w)).withColumn("n_tests", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    out = out.withColumn("holm_threshold", alpha / (F.col("n_tests") - F.col("holm_rank") + 1))
    passed = F.min((F.col(p) <= F.col("holm_threshold")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("holm_reject", passed == 1)


def pairwise_deltas(units: DataFrame, unit: list[str], pairs: DataFrame, metrics: list[str]) -> DataFrame:
    """split_family, metric, policy_a, policy_b, unit, delta for all complete cells.

    A cell with a unit that has only one side is left out whole.
    """
    long = units.unpivot([*unit, "split_family", "policy"], metrics, "metric", "value").groupBy(*unit, "split_family", "policy", "metric").agg(F.avg("value").alias("value"))
    a = long.join(F.broadcast(pairs), long.policy == pairs.policy_a).select(*unit, "split_family", "metric", "policy_a", "policy_b", F.col("value").alias("a"))
    b = long.join(F.broadcast(pairs), long.policy == pairs.policy_b).select(*unit, "split_family", "metric", "policy_a", "policy_b", F.col("value").alias("b"))
    keys = [*unit, "split_family", "metric", "policy_a", "policy_b"]
    both = a.join(b, keys, "full").where("a is not null or b is not null")
    cell = ["split_family", "metric", "policy_a", "policy_b"]
    whole = both.groupBy(*cell).agg(F.max((F.col("a").isNull() | F.col("b").isNull()).cast("int")).alias("half")).where("half = 0").drop("half")
    return both.join(whole, cell, "left_semi").withColumn("delta", F.col("a") - F.col("b"))


def unit_columns(units: DataFrame, names: list[str]) -> DataFrame:
    """split_family, unit_cols: the names whose values aren't all missing in that family, joined by '|'; none is an error."""
    have = [c for c in names if c in units.columns]
    found = units.groupBy("split_family").agg(*[F.count(c).alias(c) for c in have])
    joined = F.concat_ws("|", *[F.when(F.col(c) > 0, c) for c in have])
    return found.select("split_family", F.when(joined == "", F.raise_error(F.lit("no unit columns")).cast("string")).otherwise(joined).alias("unit_cols"))


def family_pairwise(units: DataFrame, names: list[str], pairs: DataFrame, metrics: list[str], lower: tuple[str, ...], repeats: int = 2000, seed: int = SEED) -> DataFrame:
    """pairwise_table() with unit columns inferred per split family, given as unit_cols.

    A column without values in a family is the same for all its rows, so it does not
    tell units apart there; missing values count as one value.
    """
    have = [c for c in names if c in units.columns]
    text = units.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("<missing>")) for c in have})
    return pairwise_table(text, have, pairs, metrics, lower, repeats, seed).join(unit_columns(units, names), "split_family")


def pairwise_table(units: DataFrame, unit: list[str], pairs: DataFrame, metrics: list[str], lower: tuple[str, ...], repeats: int = 2000, seed: int = SEED) -> DataFrame:
    """One row per cell: estimate, interval, p value, units, beneficial; all cells in one job."""
    cell = ["split_family", "metric", "policy_a", "policy_b"]
    d = pairwise_deltas(units, unit, pairs, metrics)
    out = bootstrap_ci(d, "delta", cell, repeats, seed=seed).join(signflip_p(d, "delta", cell, repeats, seed + 1).drop("n"), cell)
    return out.withColumn("beneficial", beneficial(F.col("metric"), F.col("estimate"), lower))


def beneficial(metric: Column, estimate: Column, lower: tuple[str, ...]) -> Column:
    return F.when(metric.isin(*lower), estimate < 0).otherwise(estimate > 0)


def policy_ci(units: DataFrame, metrics: list[str], clusters: list[str], repeats: int = 500) -> DataFrame:
    """Per family, policy and metric the nested interval of the unit means."""
    keys = [c for c in clusters if c in units.columns]
    long = units.unpivot([*keys, "split_family", "policy"], metrics, "metric", "value").groupBy(*keys, "split_family", "policy", "metric").agg(F.avg("value").alias("value"))
    return nested_bootstrap_ci(long, "value", keys, ["split_family", "policy", "metric"], repeats)


def report_pairwise(units: DataFrame, unit: list[str], pairs: DataFrame, metrics: list[str], lower: tuple[str, ...], repeats: int = 2000) -> DataFrame:
    """pairwise_table() with Holm's correction within each family and metric, and the joint flag."""
    t = holm_annotate(pairwise_table(units, unit, pairs, metrics, lower, repeats), ["split_family", "metric"], "p_value", ["policy_a", "policy_b"])
    return t.withColumn("beneficial_and_holm_significant", F.col("beneficial") & F.col("holm_reject"))


def report_pairs(units: DataFrame, left: str = "agency_margin_tau_", right: str = "set_acsa_tau_", base: str = "user_only") -> DataFrame:
    """comparison_family, policy_a, policy_b: matched budgets, and each margin policy against the user alone."""
    p = units.select("policy").distinct()
    token = lambda prefix: F.substring("policy", len(prefix) + 1, 1 << 10)
    a = p.where(F.col("policy").startswith(left)).select(token(left).alias("tau"), F.col("policy").alias("policy_a"))
    b = p.where(F.col("policy").startswith(right)).select(token(right).alias("tau"), F.col("policy").alias("policy_b"))
    alone = a.withColumn("policy_b", F.lit(base)).join(p.select(F.col("policy").alias("policy_b")), "policy_b", "left_semi")
    kind = lambda df, name: df.select(F.lit(name).alias("comparison_family"), "policy_a", "policy_b")
    return kind(a.join(b, "tau"), "matched_tau").unionByName(kind(alone, "vs_user_only"))


def report_tables(units: DataFrame, names: list[str], metrics: list[str], lower: tuple[str, ...], repeats: int = 2000) -> DataFrame:
    """Both tables of the report, Holm's correction within each comparison family, split family and metric."""
    pairs = report_pairs(units)
    t = family_pairwise(units, names, pairs.select("policy_a", "policy_b"), metrics, lower, repeats).join(F.broadcast(pairs), ["policy_a", "policy_b"])
    t = holm_annotate(t, ["comparison_family", "split_family", "metric"], "p_value", ["policy_a", "policy_b"])
    return t.withColumn("beneficial_and_holm_significant", F.col("beneficial") & F.col("holm_reject"))


def candidate_pairwise(units: DataFrame, names: list[str], metrics: list[str], lower: tuple[str, ...], repeats: int = 2000) -> DataFrame:
    """The matched-budget rows of a candidate with tau; Holm's correction over taus within each family and metric."""
    pairs = report_pairs(units).where("comparison_family = 'matched_tau'").drop("comparison_family")
    t = family_pairwise(units, names, pairs, metrics, lower, repeats)
    return holm_annotate(t, ["split_family", "metric"], "p_value", ["policy_a", "policy_b"]).withColumn("tau", F.regexp_extract("policy_a", r"tau_([0-9.]+)", 1))
