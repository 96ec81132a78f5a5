"""Posterior scoring and calibration: temperature by grid zoom, class alignment, model fits by split."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from heddle.functions.arrays import EPS, argmax, at_temperature, clip_normalize, entropy, normalize
from heddle.operators import fusion
from heddle.operators.metrics import nll
from heddle.operators.sequences import ASSIST, Modality, temporal_features
from heddle.operators.trees import extra_trees
from heddle.sources.store import scratch, stored

T_LOW, T_HIGH = 0.25, 8.0


#: Groups whose table goes to all tasks.
FEW_GROUPS = 100_000


def _logs(df: DataFrame, by: list[str], probs: str) -> DataFrame:
    """by, label, logs: the logarithms of the clipped vectors, which is all that losses need; null where a row has no loss."""
    return df.select(*by, F.col("label").cast("long").alias("label"), F.transform(clip_normalize(F.col(probs)), lambda x: F.log(x)).alias("logs"))


def _losses_at(logs: np.ndarray, label: np.ndarray, t: np.ndarray) -> np.ndarray:
    """metrics.nll() of arrays.at_temperature() of rows of logarithms (n x K), each at its t."""
    w = np.exp(logs / t[:, None] - (logs / t[:, None]).max(axis=1, keepdims=True))
    q = np.clip(w / w.sum(axis=1, keepdims=True), EPS, 1.0)
    return -np.log(np.maximum(q[np.arange(len(label)), label] / q.sum(axis=1), EPS))


#: What metrics.nll() gives a row without label or vector.
NO_LOSS = float(-np.log(EPS))


def _sums(rows: DataFrame, by: list[str], f, missing: float | None = None, width: int | None = None) -> DataFrame:
    """by, k, s, n: for each group the sum over its rows of the k-th of the numbers f gives for each row, and its rows.

    f(logs (n x K), label, t (n x the row's temperatures)) -> n x numbers. Rows: by, label,
    logs, t; each task adds up its own in numpy, and only sums are shuffled. Rows without
    label or vector count as missing for all numbers (as many as width, else as t has), or not at all.
    """
    types = {c: rows.schema[c].dataType for c in by}
    schema = "".join(f"`{c}` {t.simpleString()}, " for c, t in types.items()) + "k int, s double, n long"
    typed = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        found: dict[tuple, tuple] = {}

        def out():
            each = [(*g, k, float(x), n) for g, (s, n) in found.items() for k, x in enumerate(s)]
            found.clear()
            columns = zip(*each, strict=True) if each else [[] for _ in typed]
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, typed, strict=True)], schema=typed)

        for b in batches:
            if not b.num_rows:
                continue
            size = pc.fill_null(pc.list_value_length(b.column("logs")), -1).to_numpy(zero_copy_only=False)
            label = pc.fill_null(b.column("label"), 0).to_numpy(zero_copy_only=False)
            has = b.column("label").is_valid().to_numpy(zero_copy_only=False) & (size >= 0)
            if ((label < 0) | (label >= size))[has].any():
                raise ValueError("label beyond the vector")
            names: dict[tuple, int] = {}
            columns = [b.column(c).to_pylist() for c in by]
            group = np.array([names.setdefault(x, len(names)) for x in zip(*columns, strict=True)] if by else [names.setdefault((), 0)] * b.num_rows)
            for k in np.unique(size[has]):
                at = np.flatnonzero(has & (size == k))
                own = b.take(pa.array(at))
                matrix = lambda c: own.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)  # noqa: B023, E731
                x = f(matrix("logs"), label[at], matrix("t"))
                n = np.bincount(group[at], minlength=len(names))
                sums = np.array([np.bincount(group[at], x[:, j], minlength=len(names)) for j in range(x.shape[1])])
                for g, i in names.items():
                    if n[i]:
                        s, m = found.get(g, (0.0, 0))
                        found[g] = (s + sums[:, i], m + int(n[i]))
            if missing is not None and not has.all():
                n, wide = np.bincount(group[~has], minlength=len(names)), width or len(b.column("t")[0])
                for g, i in names.items():
                    if n[i]:
                        s, m = found.get(g, (0.0, 0))
                        found[g] = (s + np.full(wide, missing * n[i]), m + int(n[i]))
            if len(found) >= FEW_GROUPS:
                yield out()
        yield out()

    return rows.mapInArrow(run, schema).groupBy(*by, "k").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def _each_loss(logs, label, t):
    return np.stack([_losses_at(logs, label, t[:, j]) for j in range(t.shape[1])], axis=1)


def temperature_losses(df: DataFrame, by: list[str], grid: list[float], probs: str = "p_assist") -> DataFrame:
    """by, t, loss: mean negative log likelihood at each temperature of the grid."""
    if min(grid) <= 0:
        raise ValueError("temperature must be positive")
    every = np.array([grid], float)
    rows = _logs(df, by, probs).withColumn("t", F.array(F.lit(1.0)))
    sums = _sums(rows, by, lambda logs, label, t: _each_loss(logs, label, np.broadcast_to(every, (len(label), every.shape[1]))), NO_LOSS, len(grid))
    return sums.select(*by, F.element_at(F.array(*[F.lit(float(t)) for t in grid]), F.col("k") + 1).alias("t"), (F.col("s") / F.col("n")).alias("loss"))


def losses_at(df: DataFrame, temperatures: DataFrame, by: list[str], probs: str = "p_assist") -> DataFrame:
    """by, temperature, loss: the mean negative log likelihood at each group's own temperature (by, temperature)."""
    rows = _logs(df, by, probs).join(temperatures, by)
    sums = _sums(rows.withColumn("t", F.array("temperature")), [*by, "temperature"], _each_loss, NO_LOSS)
    return sums.select(*by, "temperature", (F.col("s") / F.col("n")).alias("loss"))


def fit_temperature(df: DataFrame, by: list[str], probs: str = "p_assist", rounds: int = 2, points: int = 9, steps: int = 4) -> DataFrame:
    """by, temperature: the one of least mean loss within its bounds; 1 where the rows hold under two classes.

    A grid is refined around its best, then Newton steps follow in the inverse
    temperature, in which the loss is convex. Rows are reduced to their logarithms and
    stored once; each round is one pass over these, of which tasks send sums by group.
    """
    step = (T_HIGH - T_LOW) / (points - 1)
    rows = stored(_logs(df, by, probs), "logs")
    classes = rows.groupBy(*by).agg(F.count_distinct("label").alias("k")).persist()
    small = F.broadcast if classes.count() <= FEW_GROUPS else (lambda x: x)
    best = classes.select(*by, F.lit((T_LOW + T_HIGH) / 2).alias("mid"))
    half = points // 2
    for r in range(rounds):
        width = step / ((points - 1) / 2) ** r
        grid = F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda k: F.least(F.greatest(F.col("mid") + k * F.lit(width), F.lit(T_LOW)), F.lit(T_HIGH)))
        losses = _sums(rows.join(small(best.select(*by, grid.alias("t"))), by), by, _each_loss, NO_LOSS)
        mid = F.least(F.greatest(F.col("mid") + (F.col("i") - half) * F.lit(width), F.lit(T_LOW)), F.lit(T_HIGH))
        at = losses.withColumnRenamed("k", "i").join(best, by).withColumns({"t": mid, "loss": F.col("s") / F.col("n")})
        best = at.groupBy(*by).agg(F.min_by("t", F.struct("loss", "t")).alias("mid"))

    def slopes(logs, label, t):
        w = np.exp((logs - logs.max(axis=1, keepdims=True)) / t)
        z = w.sum(axis=1)
        mean = (w * logs).sum(axis=1) / z
        return np.stack([mean - logs[np.arange(len(label)), label], (w * logs * logs).sum(axis=1) / z - mean * mean], axis=1)

    for _ in range(steps):
        at = _sums(rows.join(small(best), by).withColumn("t", F.array("mid")), [*by, "mid"], slopes)
        pick = lambda k: F.max(F.when(F.col("k") == k, F.col("s") / F.col("n")))
        sums = at.groupBy(*by, "mid").agg(pick(0).alias("slope"), pick(1).alias("curve"))
        inverse = 1 / F.col("mid") - F.when(F.col("curve") > 1e-12, F.col("slope") / F.col("curve")).otherwise(0.0)
        best = sums.select(*by, (1 / F.least(F.greatest(inverse, F.lit(1 / T_HIGH)), F.lit(1 / T_LOW))).alias("mid"))
    return classes.join(best, by, "left").where("k < 2 or mid is not null").select(*by, F.when(F.col("k") < 2, 1.0).otherwise(F.col("mid")).alias("temperature"))


def class_weights(df: DataFrame, classes: int, label: str = "label") -> DataFrame:
    """label, weight: n / (K count), 1 for a class without rows."""
    every = df.sparkSession.range(classes).select(F.col("id").cast("int").alias(label))
    counts = df.groupBy(F.col(label).cast("int").alias(label)).agg(F.count(F.lit(1)).alias("c"))
    n = df.agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, label, "left").crossJoin(F.broadcast(n)).select(label, F.when(F.col("c").isNull(), 1.0).otherwise(F.col("n") / (classes * F.col("c"))).alias("weight"))


def assemble_traces(rows: DataFrame, user: DataFrame, assist: DataFrame, user_temperature: DataFrame | None = None, assist_temperature: DataFrame | None = None) -> DataFrame:
    """Rows (split_id, row_id, label and any metadata) with both posteriors (split_id, row_id, p).

    Temperatures (split_id, temperature), where given, are applied to their posterior and
    kept; a split without one has 1. uncertainty is the scaled assistant's entropy.
    """
    keys = ["split_id", "row_id"]
    t = rows.join(user.select(*keys, F.col("p").alias("p_user")), keys).join(assist.select(*keys, F.col("p").alias("p_assist")), keys)
    for role, fitted in (("user", user_temperature), ("assist", assist_temperature)):
        name = f"{role}_temperature"
        if fitted is None:
            t = t.withColumn(name, F.lit(1.0))
            continue
        t = t.join(fitted.select("split_id", F.col("temperature").alias(name)), "split_id", "left").withColumn(name, F.coalesce(name, F.lit(1.0)))
        t = t.withColumn(f"p_{role}", at_temperature(F.col(f"p_{role}"), F.col(name)))
    return t.withColumn("uncertainty", entropy(F.col("p_assist")))


def trace_frame(traces: DataFrame) -> DataFrame:
    out = traces
    for role in ("user", "assist"):
        p = F.col(f"p_{role}")
        out = out.withColumn(f"{role}_action", argmax(p)).withColumn(f"{role}_confidence", F.array_max(p)).withColumn(f"{role}_correct", argmax(p) == F.col("label"))
    return out


def blend_weight(df: DataFrame, grid: list[float], classes: int | None, by: list[str] | None = None) -> DataFrame:
    """by, weight, macro_f1, accuracy, loss: the blend weight best by macro-F1, accuracy, loss; the first on ties.

    macro_f1 is a mean over so many classes, or over those that occur as label or choice.
    """
    by = by or []
    e = df.select(*by, "label", "p_user", "p_assist", F.explode(F.array(*map(F.lit, grid))).alias("weight"))
    e = e.withColumn("p", F.zip_with("p_user", "p_assist", lambda x, y: (1 - F.col("weight")) * x + F.col("weight") * y)).withColumn("x", argmax(F.col("p")))
    rows = e.groupBy(*by, "weight").agg(F.avg((F.col("x") == F.col("label")).cast("double")).alias("accuracy"), F.avg(nll(F.col("p"), F.col("label"))).alias("loss"))
    ends = e.select(*by, "weight", F.explode(F.array(F.struct(F.col("label").alias("c"), (F.col("x") == F.col("label")).cast("long").alias("tp")), F.struct(F.col("x").alias("c"), F.lit(0).cast("long").alias("tp")))).alias("s"))
    f1 = ends.groupBy(*by, "weight", "s.c").agg(F.sum("s.tp").alias("tp"), F.count(F.lit(1)).alias("n")).groupBy(*by, "weight").agg((F.sum(2 * F.col("tp") / F.col("n")) / (classes or F.count(F.lit(1)))).alias("macro_f1"))
    both = rows.join(f1, [*by, "weight"])
    key = F.struct("macro_f1", "accuracy", (-F.col("loss")).alias("l"), (-F.col("weight")).alias("w"))
    return both.groupBy(*by).agg(F.max_by(F.struct("weight", "macro_f1", "accuracy", "loss"), key).alias("b")).select(*by, "b.*")


#: From so many training rows on, a forest adds up the statistics of few nodes at once, which took less CPU time.
MANY_ROWS, FEW_NODES_MB = 50_000, 4


def estimator(spec: str, features: int, classes: int, seed: int = 7, trees: int = 512, hidden: tuple[int, ...] = (512, 256), iterations: int = 2000, rows: int = 0):
    """Estimators of Spark ML by name, of the reference's sizes. The multilayer perceptron has neither class weights nor early stopping."""
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier

    common = {"featuresCol": "x", "labelCol": "label", "probabilityCol": "p"}
    if spec == "logistic":
        return LogisticRegression(**common, weightCol="weight", maxIter=iterations, regParam=1e-4)
    if spec == "forest":
        return RandomForestClassifier(**common, weightCol="weight", numTrees=trees, featureSubsetStrategy="sqrt", seed=seed, maxMemoryInMB=FEW_NODES_MB if rows >= MANY_ROWS else 256)
    if spec == "mlp":
        return MultilayerPerceptronClassifier(**common, layers=[features, *hidden, classes], maxIter=40, seed=seed)
    raise ValueError(f"unknown model: {spec}")


def _tasks(spark) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fit_score(df: DataFrame, members: DataFrame | Callable[[DataFrame], DataFrame], spec: str, classes: int, parallel: int = 4, failures: dict[str, str] | None = None, **sizes) -> DataFrame:
    """split_id, row_id, role, p: each split's model fitted on its training rows, scoring the others.

    df: row_id, label, features. Where members is a function of df, it is given the stored
    rows with all their columns, so that df is made once. Up to `parallel` splits are fitted at once by threads of
    the driver over shared features; rows stay distributed. Class weights come from a
    split's own training rows. Splits whose training rows hold under two classes are
    skipped; no rows are left where all are. A split that fails doesn't stop the others:
    its error goes to `failures`, or is raised at the end where none is given.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target
    from pyspark.ml.functions import array_to_vector

    data = stored(df if callable(members) else df.select("row_id", "label", "features"), "rows")
    members = members(data) if callable(members) else members
    data = data.select("row_id", "label", "features")
    first = data.select("features").first()
    members = stored(members.select("split_id", "row_id", "role"), "members")
    names = [r[0] for r in members.select("split_id").distinct().orderBy("split_id").collect()] if first else []
    # fits pass over a split's rows many times: joined once for all splits, and read from a folder for each
    joined = members.hint("merge").join(data, "row_id").repartition("split_id", F.pmod(F.xxhash64("row_id"), F.lit(_tasks(df.sparkSession))))
    at = scratch(df.sparkSession, "splits")
    joined.withColumn("_split", F.sha2("split_id", 256)).write.partitionBy("_split").parquet(at)
    every = df.sparkSession.read.schema(joined.schema.add("_split", "string")).parquet(at)
    errors: dict[str, str] = {}

    def one(split: str) -> DataFrame | None:
        try:
            own = every.where(F.col("_split") == sha256(split.encode()).hexdigest()).drop("_split").withColumn("v", array_to_vector("features")).drop("features")
            return _fit_one(own, spec, classes, len(first[0]), sizes)
        except Exception as e:  # noqa: BLE001
            errors[split] = str(e)
            return None

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        found = list(pool.map(inheritable_thread_target(df.sparkSession)(one), names))
    if failures is not None:
        failures.update(errors)
    elif errors:
        raise RuntimeError(f"splits that failed: {errors}")
    out = None
    for scored in found:
        if scored is not None:
            out = scored if out is None else out.unionByName(scored)
    if out is None:
        return members.select("split_id", "row_id", "role", F.lit(None).cast("array<double>").alias("p")).limit(0)
    return out


def _fit_one(own: DataFrame, spec: str, classes: int, width: int, sizes: dict) -> DataFrame | None:
    """One split's scores; None where its training rows hold under two classes."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import vector_to_array

    train, rest = own.where("role = 'train'"), own.where("role <> 'train'")
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    n = sum(counts.values())
    if spec == "fusion":
        x = vector_to_array("v", "float32")
        return fusion.fit(train.withColumn("x", x), rest.withColumn("x", x), classes, sorted(counts), sizes["layout"], sizes.get("network") or fusion.Network())
    weight = F.create_map(*[F.lit(x) for k, c in counts.items() for x in (k, n / (classes * c))])[F.col("label")]
    train = train.withColumn("weight", weight)
    if spec == "lda":
        return _lda(train, rest, classes)
    if spec == "extra_trees":
        return extra_trees(train.withColumn("x", vector_to_array("v")), rest.select("split_id", "row_id", "role", vector_to_array("v").alias("x")), classes, width, **sizes)
    model = Pipeline(stages=[StandardScaler(inputCol="v", outputCol="x", withMean=True), estimator(spec, width, classes, rows=n, **sizes)]).fit(train)
    # a model's vector ends at its largest training label
    p = vector_to_array("p")
    return model.transform(rest).select("split_id", "row_id", "role", F.concat(p, F.array_repeat(F.lit(0.0), F.lit(classes) - F.size(p))).alias("p"))


def _scatter(rows: DataFrame, d: int, center: list[float]) -> dict[tuple[int, int], float]:
    """Sums of outer products of the rows (column x) about a center, as (i, j) -> sum.

    Each partition adds its own d x d matrix in numpy; only these are shuffled.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        s = np.zeros((d, d))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d) - center
            s += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(d), d)), pa.array(np.tile(np.arange(d), d)), pa.array(s.ravel())], ["i", "j", "s"])

    got = rows.select("x").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    return {(r["i"], r["j"]): r["s"] for r in got.collect()}


def _lda(train: DataFrame, test: DataFrame, classes: int) -> DataFrame:
    """Linear discriminant: class means and pooled scatter are added up by partition; only a d x d system is solved here."""
    import numpy as np
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    means = {r.label: (r.s.mean.toArray(), r.n) for r in train.groupBy("label").agg(Summarizer.metrics("mean").summary(F.col("v")).alias("s"), F.count(F.lit(1)).alias("n")).collect()}
    n = sum(c for _, c in means.values())
    d = len(next(iter(means.values()))[0])
    middle = sum(c * m for m, c in means.values()) / n
    s = np.zeros((d, d))
    for (i, j), x in _scatter(train.select(vector_to_array("v").alias("x")), d, middle.tolist()).items():
        s[i, j] = x
    s = (s - sum(c * np.outer(m - middle, m - middle) for m, c in means.values())) / n + 1e-6 * np.eye(d)
    weights = np.zeros((classes, d))
    bias = np.full(classes, -1e9)
    for k, (m, c) in means.items():
        weights[int(k)] = np.linalg.solve(s, m)
        bias[int(k)] = -0.5 * m @ weights[int(k)] + np.log(c / n)
    x = vector_to_array("v")
    score = lambda k: F.aggregate(F.zip_with(x, F.array(*map(F.lit, weights[k].tolist())), lambda a, b: a * b), F.lit(float(bias[k])), lambda acc, y: acc + y)
    scored = test.withColumn("_s", F.array(*[score(k) for k in range(classes)])).withColumn("_e", F.transform("_s", lambda y: F.exp(y - F.array_max("_s"))))
    return scored.select("split_id", "row_id", "role", F.transform("_e", lambda y: y / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)).alias("p"))


def temporal_forest(df: DataFrame, members: DataFrame | Callable[[DataFrame], DataFrame], classes: int, modalities: tuple[Modality, ...] = ASSIST, chunks: int = 4, **sizes) -> DataFrame:
    """fit_score() of a forest on tabular features with the summaries of each row's sequences.

    Rows are weighted by their class; the trees' own samples are drawn with these
    weights on average, not balanced one by one.
    """
    return fit_score(temporal_features(df, modalities, chunks=chunks), members, "forest", classes, **sizes)


BLENDS = (0.0, 0.15, 0.30, 0.45, 0.60, 0.75, 1.0)


def choose_blends(splits: DataFrame, validation: DataFrame, grid: tuple[float, ...] = BLENDS) -> DataFrame:
    """split_id, weight: of the grid, best on the split's validation rows (split_id, label, p_user, p_assist); 0.5 without such rows."""
    best = blend_weight(validation, list(grid), None, ["split_id"]).select("split_id", "weight")
    return splits.select("split_id").distinct().join(best, "split_id", "left").select("split_id", F.coalesce("weight", F.lit(0.5)).alias("weight"))


def blend_posteriors(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """rows with p: the mixture of p_user and p_assist by their split's weight, normalised."""
    mixed = F.zip_with("p_user", "p_assist", lambda x, y: (1 - F.col("weight")) * x + F.col("weight") * y)
    return rows.join(weights, "split_id").withColumn("p", normalize(mixed)).drop("weight")


def stacked_blend(df: DataFrame, members: DataFrame | Callable[[DataFrame], DataFrame], specs: tuple[str, str], classes: int, grid: tuple[float, ...] = BLENDS, share: float = 0.1, seed: int = 0, least: int = 256, modalities: tuple[Modality, ...] = ASSIST, network: fusion.Network | None = None, **sizes) -> DataFrame:
    """split_id, row_id, role, p: two models blended by a weight chosen on held-out training rows.

    Both models are fitted without a split's held-out share of its training rows, which
    dev_holdout() draws within each label (none under `least` rows, and the weight is 0.5
    then); the weight of the grid that is best there blends both models refitted on all
    training rows. The reference's are ("extra_trees", "fusion"): trees on the tabular
    features, and the network on these and the modalities' sequences. Where members is a
    function, it is given the stored rows, as in fit_score().
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    from heddle.operators.splits import dev_holdout

    df = stored(df, "stack") if "fusion" in specs or callable(members) else df
    members = stored(members(df), "members") if callable(members) else members
    of = fusion.layout(df, modalities) if "fusion" in specs else None
    rows = {s: stored(fusion.packed(df, modalities), "packed") if s == "fusion" else df for s in specs}
    own = {s: {"layout": of, "network": network} if s == "fusion" else sizes for s in specs}
    train = members.where("role = 'train'").join(df.select("row_id", "label"), "row_id")
    inner = dev_holdout(train, share, seed, least, ["split_id"])
    held = inner.where("role = 'dev'").select("split_id").distinct()
    inner = inner.join(held, "split_id", "left_semi").persist()
    # a refit on all rows doesn't wait for the weight, nor one model for the other
    fits = [(spec, on) for on in (inner, members) for spec in specs]
    first = inheritable_thread_target(df.sparkSession)(lambda spec, on: fit_score(rows[spec], on, spec, classes, **own[spec]))
    with ThreadPoolExecutor(max_workers=len(fits)) as pool:
        found = list(pool.map(first, *zip(*fits, strict=True)))
    pair = lambda a, b: a.withColumnRenamed("p", "p_user").join(b.select("split_id", "row_id", F.col("p").alias("p_assist")), ["split_id", "row_id"])
    validation = pair(*found[:2]).join(df.select("row_id", "label"), "row_id")
    return blend_posteriors(pair(*found[2:]), choose_blends(members, validation, grid)).select("split_id", "row_id", "role", "p")
