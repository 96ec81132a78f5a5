"""Windows and features of long-form signals: (record_id, t, value, label, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators.ordered import exact_quantiles


def label_segments(samples: DataFrame, min_len: int = 1, include_rest: bool = True) -> DataFrame:
    """record_id, segment, label, start, end (exclusive), length: maximal runs of a label; numbered after filtering."""
    w = Window.partitionBy("record_id").orderBy("t")
    change = F.coalesce((F.col("label") != F.lag("label").over(w)).cast("int"), F.lit(0))
    runs = samples.select("record_id", "t", "label", change.alias("c")).withColumn("run", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = runs.groupBy("record_id", "run").agg(F.first("label").alias("label"), F.min("t").alias("start"), (F.max("t") + 1).alias("end"))
    s = s.withColumn("length", F.col("end") - F.col("start")).where(F.col("length") >= min_len)
    if not include_rest:
        s = s.where("label <> 0")
    return s.select("record_id", (F.row_number().over(Window.partitionBy("record_id").orderBy("start")) - 1).alias("segment"), "label", "start", "end", "length")


def prefix_windows(segments: DataFrame, grid_s: list[float], rate: float, user_window_s: float, offset: int = 0) -> DataFrame:
    """Segments by prefix lengths that fit; lengths are rounded half to even."""
    user = F.bround(F.lit(user_window_s * rate)).cast("long")
    g = segments.withColumn("prefix_s", F.explode(F.array(*map(F.lit, grid_s)))).withColumn("prefix", F.bround(F.col("prefix_s") * rate).cast("long")).withColumn("user", user)
    start = F.col("start") + offset
    return g.where("user <= prefix").where(F.col("prefix") <= F.col("end") - start).select("record_id", "segment", "label", "prefix_s", start.alias("assist_start"), (start + F.col("prefix") - F.col("user")).alias("user_start"), (start + F.col("prefix")).alias("stop"))


def sliding_windows(samples: DataFrame, size: int, step: int) -> DataFrame:
    """Adds window (its start) to each sample, once per full window that holds it."""
    if size <= 0 or step <= 0:
        raise ValueError("size and step must be positive")
    last = F.max("t").over(Window.partitionBy("record_id"))
    t = F.col("t")
    low = F.greatest(F.lit(0), F.ceil((t - size + 1) / step)) * step
    high = F.least(F.floor(t / step), F.floor((F.col("_last") - size + 1) / step)) * step
    return samples.withColumn("_last", last).where(F.col("_last") + 1 >= size).withColumn("_lo", low.cast("long")).withColumn("_hi", high.cast("long")).where("_lo <= _hi").withColumn("window", F.explode(F.expr(f"sequence(_lo, _hi, {step}L)"))).drop("_last", "_lo", "_hi")


def td_features(windowed: DataFrame, by: tuple[str, ...] = ("record_id", "window")) -> DataFrame:
    """mav, rms, wl, zc, ssc of each window; 0 counts as positive in zero crossings."""
    w = Window.partitionBy(*by).orderBy("t")
    v = F.col("value")
    d = windowed.withColumn("_d", v - F.lag(v).over(w)).withColumn("_s", F.coalesce(((v < 0) != (F.lag(v).over(w) < 0)).cast("int"), F.lit(0)))
    d = d.withColumn("_t", F.coalesce(((F.col("_d") < 0) != (F.lag("_d").over(w) < 0)).cast("int"), F.lit(0)))
    return d.groupBy(*by).agg(F.avg(F.abs(v)).alias("mav"), F.sqrt(F.avg(v * v)).alias("rms"), F.coalesce(F.sum(F.abs("_d")), F.lit(0.0)).alias("wl"), F.sum("_s").alias("zc"), F.sum("_t").alias("ssc"))


def energy_thirds(windowed: DataFrame, by: tuple[str, ...] = ("record_id", "window")) -> DataFrame:
    """RMS of the three thirds, earlier ones longer where they can't be equal; 0 for an empty one."""
    part = F.ntile(3).over(Window.partitionBy(*by).orderBy("t"))
    e = windowed.withColumn("_p", part)
    rms = lambda k: F.coalesce(F.sqrt(F.avg(F.when(F.col("_p") == k, F.col("value") * F.col("value")))), F.lit(0.0))
    return e.groupBy(*by).agg(*[rms(k).alias(f"third{k}") for k in (1, 2, 3)])


def masked_summary(windowed: DataFrame, by: tuple[str, ...] = ("record_id", "window")) -> DataFrame:
    """Mean and population deviation over valid samples, and the share missing."""
    ok = F.when(~F.col("invalid") & F.col("value").isNotNull() & ~F.isnan("value"), F.col("value"))
    return windowed.groupBy(*by).agg(F.coalesce(F.avg(ok), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(ok), F.lit(0.0)).alias("std"), (1 - F.count(ok) / F.count(F.lit(1))).alias("missing"))


def window_mode(windowed: DataFrame, by: tuple[str, ...] = ("record_id", "window")) -> DataFrame:
    """The most frequent label, the smallest on ties."""
    return windowed.groupBy(*by).agg(F.mode("label", True).alias("label"))


def availability(windowed: DataFrame, by: tuple[str, ...] = ("record_id", "window")) -> DataFrame:
    return windowed.groupBy(*by).agg(F.bool_or(~F.col("invalid")).alias("available"))


def context_features(df: DataFrame, mode: str, prefix_grid: list[float], dynamic: str, position: str, prefix: str, flags: list[str], object_id: str | None = None, object_part: str | None = None) -> DataFrame:
    """context: nothing, the protocol's one-hots and flags, or these and the object's identity and part (25 each)."""
    from heddle.functions.arrays import one_hot

    if mode == "sensor_summary":
        return df.withColumn("context", F.array().cast("array<double>"))
    parts = [one_hot(F.col(dynamic), [0, 1]), one_hot(F.col(position), [0, 1]), one_hot(F.col(prefix), prefix_grid), F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in flags])]
    if mode == "annotated_object_proxy":
        parts += [one_hot(F.col(object_id), list(range(25))), one_hot(F.col(object_part), list(range(25)))]
    elif mode != "protocol_context":
        raise ValueError(f"unknown context mode: {mode}")
    return df.withColumn("context", F.concat(*parts))


def compress_sequence(samples: DataFrame, max_len: int, source_len: int) -> DataFrame:
    """record_id, bin, value: each record's time axis in round(n * max / source) bins of floor-edged slices."""
    if max_len <= 0 or source_len <= 0:
        raise ValueError("lengths must be positive")
    if source_len <= max_len:
        return samples.select("record_id", F.col("t").alias("bin"), "value")
    n = F.count(F.lit(1)).over(Window.partitionBy("record_id"))
    s = samples.withColumn("_n", n).withColumn("_k", F.least(F.greatest(F.bround(F.col("_n") * float(max_len) / float(source_len)).cast("long"), F.lit(1).cast("long")), F.col("_n")))
    # the largest bin whose first sample isn't after t
    near = F.floor((F.col("t") + 1) * F.col("_k") / F.col("_n"))
    bin_ = F.when((near < F.col("_k")) & (F.floor(near * F.col("_n") / F.col("_k")) <= F.col("t")), near).otherwise(near - 1)
    return s.withColumn("bin", bin_.cast("long")).groupBy("record_id", "bin").agg(F.avg("value").alias("value"))


def slice_mask(samples: DataFrame, start: int, end: int) -> DataFrame:
    """record_id, t, value, valid over [start, end): zeros and invalid outside the record."""
    grid = samples.select("record_id").distinct().withColumn("t", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(end - 1).cast("long"))))
    own = samples.where((F.col("t") >= start) & (F.col("t") < end)).select("record_id", "t", "value", (~F.col("invalid")).cast("int").alias("valid"))
    return grid.join(own, ["record_id", "t"], "left").withColumn("value", F.coalesce("value", F.lit(0.0))).withColumn("valid", F.coalesce("valid", F.lit(0)))


def sequence_summary(samples: DataFrame, chunks: int = 4, by: str = "record_id") -> DataFrame:
    """Masked mean, deviation, last minus first, availability, and mean and availability of each chunk."""
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    valid = (~F.col("invalid")).cast("double")
    s = samples.select(by, "t", "value", valid.alias("m")).withColumn("n", n)
    for c in range(chunks):
        s = s.withColumn(f"c{c}", (F.col("t") >= F.floor(F.col("n") * c / chunks)) & (F.col("t") < F.floor(F.col("n") * (c + 1) / chunks)))
    v, m = F.col("value"), F.col("m")
    count = F.greatest(F.sum(m), F.lit(1.0))
    inside = lambda c, x: F.sum(F.when(F.col(f"c{c}"), x).otherwise(0.0))
    parts = []
    for c in range(chunks):
        size = F.greatest(F.sum(F.col(f"c{c}").cast("int")), F.lit(1))
        k = F.greatest(inside(c, m), F.lit(1.0))
        parts += [(inside(c, v * m) / k).alias(f"mean{c}"), (k / size).alias(f"available{c}")]
    at = lambda f, key: f(v, F.when(m > 0, key))
    first = F.coalesce(at(F.min_by, F.col("t")), F.min_by(v, F.col("t")))
    last = F.coalesce(at(F.max_by, F.col("t")), F.min_by(v, F.col("t")))
    out = s.groupBy(by).agg((F.sum(v * m) / count).alias("mean"), F.sum(v * v * m).alias("_sq"), F.sum(v * m).alias("_s"), F.sum(m).alias("_m"), (last - first).alias("delta"), (count / F.count(F.lit(1))).alias("available"), *parts)
    k = F.greatest("_m", F.lit(1.0))
    var = (F.col("_sq") - 2 * F.col("mean") * F.col("_s") + F.col("mean") * F.col("mean") * F.col("_m")) / k
    return out.withColumn("std", F.sqrt(F.greatest(var, F.lit(0.0)))).drop("_sq", "_s", "_m")


def _scaled(df: DataFrame, column: str, centers: list[float], scales: list[float]) -> DataFrame:
    """(x - center) / scale of each feature; the statistics are literals, so rows stay where they are."""
    c, s = F.array(*[F.lit(float(x)) for x in centers]), F.array(*[F.lit(float(x)) for x in scales])
    return df.withColumn(column, F.transform(column, lambda x, i: (x - F.get(c, i)) / F.get(s, i)))


def robust_z(df: DataFrame, key: str, column: str = "features", eps: float = 1e-8) -> DataFrame:
    """key, features: (x - median) / (1.4826 MAD + eps) of each feature, by exact medians.

    Medians come from counts of digits; a row's features are never taken apart but on
    the map side. Without rows there is nothing to scale.
    """
    rows = df.select(key, column)
    values = rows.select(F.posexplode(column).alias("i", "x"))
    medians = exact_quantiles(values, ["i"], "x", [0.5])
    centers = [medians[(i,)][0] for i in range(len(medians))]
    away = rows.select(F.posexplode(F.transform(column, lambda x, i: F.abs(x - F.get(F.array(*[F.lit(c) for c in centers]), i)))).alias("i", "x"))
    spans = exact_quantiles(away, ["i"], "x", [0.5])
    return _scaled(rows, column, centers, [1.4826 * spans[(i,)][0] + eps for i in range(len(centers))])


def feature_moments(df: DataFrame, column: str = "features") -> tuple[list[float], list[float]]:
    """Means and population deviations of each feature, added up inside the partitions."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    got = df.where(F.col(column).isNotNull()).agg(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(column)).alias("s")).first()["s"]
    n = got["count"]
    share = (n - 1) / n if n > 1 else 0.0
    return [float(x) for x in got["mean"]], [float(x * share) ** 0.5 for x in got["variance"]]


def standardize(fit: DataFrame, df: DataFrame, key: str, column: str = "features", least: float = 1e-6) -> DataFrame:
    """Means and population deviations of fit's features applied to df; deviations under `least` count as 1."""
    mean, deviation = feature_moments(fit, column)
    return _scaled(df.select(key, column), column, mean, [1.0 if d < least else d for d in deviation])


def channel_dropout(df: DataFrame, key: str, rate: float, seed: int, column: str = "features") -> DataFrame:
    """Zero each feature with probability rate, by a hash of (row, feature, seed)."""
    return df.withColumn(column, F.transform(column, lambda x, i: F.when(F.pmod(F.xxhash64(F.col(key), i, F.lit(seed)), F.lit(1_000_000)) < int(rate * 1_000_000), 0.0).otherwise(x)))


def fir_filter(samples: DataFrame, taps: list[float]) -> DataFrame:
    """Zero-phase symmetric filter with an odd number of taps; at the ends the taps outside count 0 and the rest is rescaled."""
    if len(taps) % 2 == 0 or list(taps) != list(reversed(taps)):
        raise ValueError("taps must be symmetric and odd in number")
    w, half = Window.partitionBy("record_id").orderBy("t"), len(taps) // 2
    at = lambda k: F.lead("value", k).over(w) if k > 0 else F.lag("value", -k).over(w) if k < 0 else F.col("value")
    num, den = F.lit(0.0), F.lit(0.0)
    for k, tap in zip(range(-half, half + 1), taps, strict=True):
        num = num + F.coalesce(at(k) * tap, F.lit(0.0))
        den = den + F.when(at(k).isNotNull(), tap).otherwise(0.0)
    return samples.withColumn("value", num * float(sum(taps)) / den)


def drift_stress(traces: DataFrame, levels: list[float]) -> DataFrame:
    """Traces once per level, p_assist at that temperature."""
    from heddle.functions.arrays import at_temperature

    t = traces.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    return t.withColumn("p_assist", at_temperature(F.col("p_assist"), F.col("level")))


def missing_modality_stress(df: DataFrame, modalities: dict[str, list[str]]) -> DataFrame:
    """Rows once per modality, whose columns are zeroed (arrays in every element)."""
    kinds, out = dict(df.dtypes), df.withColumn("missing", F.explode(F.array(*map(F.lit, modalities))))
    for name in sorted({c for cs in modalities.values() for c in cs}):
        gone = F.col("missing").isin(*[m for m, cs in modalities.items() if name in cs])
        zero = F.transform(name, lambda x: x * 0) if kinds[name].startswith("array") else F.lit(0).cast(kinds[name])
        out = out.withColumn(name, F.when(gone, zero).otherwise(F.col(name)))
    return out


def noise_stress(df: DataFrame, key: str, levels_db: list[float], seed: int, column: str = "features") -> DataFrame:
    """Rows once per signal-to-noise ratio in decibels, with Gaussian noise of that power added to each row's array.

    Normal values come from two hashes of (row, place, level, seed); a row without power stays as it is.
    """
    t = df.withColumn("snr_db", F.explode(F.array(*[F.lit(float(x)) for x in levels_db])))
    power = F.aggregate(column, F.lit(0.0), lambda s, x: s + x * x) / F.greatest(F.size(column), F.lit(1))
    scale = F.sqrt(power / F.pow(F.lit(10.0), F.col("snr_db") / 10))
    share = lambda i, tag: (F.pmod(F.xxhash64(F.col(key), i, F.col("snr_db"), F.lit(tag), F.lit(seed)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    normal = lambda i: F.sqrt(-2 * F.log(share(i, "u"))) * F.cos(2 * F.pi() * share(i, "v"))
    return t.withColumn(column, F.transform(column, lambda x, i: x + scale * normal(i)))


def latency_stress(decisions: DataFrame, levels_ms: list[float], deadline_ms: float) -> DataFrame:
    """Decisions once per added delay, with whether they still make the deadline."""
    d = decisions.withColumn("delay_ms", F.explode(F.array(*map(F.lit, levels_ms)))).withColumn("decision_time_ms", F.col("decision_time_ms") + F.col("delay_ms"))
    return d.withColumn("in_time", F.col("decision_time_ms") <= deadline_ms)


def rms(c: Column) -> Column:
    return F.sqrt(F.avg(c * c))
