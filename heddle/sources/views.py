"""Views over the star-schema tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLASSES = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: user and assist posteriors over five classes, with unit and episode keys."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("user_id") % 12).cast("int").alias("sub"), F.floor((F.dayofmonth("ts") - 1) / 3).cast("int").alias("dk"))
    e = e.withColumn("label", ((F.col("user_id") + F.col("dk")) % 5).cast("int"))

    def weights(a: int, b: int, c: int, modulus: int, below: int, bonus: int):
        return F.array(*[(1 + (F.col("event_id") * a + k * b + F.col("user_id") * c) % modulus + F.when((F.col("label") == k) & (F.col("event_id") % 10 < below), bonus).otherwise(0)).cast("double") for k in range(CLASSES)])

    def share(w: Column) -> Column:
        at = [w[k] for k in range(CLASSES)]
        return F.array(*[x / sum(at[1:], at[0]) for x in at])

    # dealt by the window's own key, to all cores: policies are long work per row
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = Window.partitionBy("user_id", "dk").orderBy("ts", "event_id")
    e = e.repartition(tasks, "user_id", "dk").withColumn("pr", F.row_number().over(order))
    e = e.withColumn("wu", weights(31, 17, 7, 97, 6, 90)).withColumn("wa", weights(13, 41, 3, 89, 8, 120))
    return e.select(
        "event_id",
        F.lit("events").alias("dataset_id"),
        F.concat(F.lit("S"), F.lpad(F.col("sub").cast("string"), 2, "0")).alias("subject_id"),
        F.when(F.col("sub") % 4 == 0, "target").otherwise("background").alias("group"),
        F.when(F.col("dk") < 5, "session1").otherwise("session2").alias("session"),
        F.concat(F.lit("D"), F.lpad(F.col("dk").cast("string"), 2, "0")).alias("day"),
        F.concat_ws(":", F.col("user_id").cast("string"), F.col("dk").cast("string")).alias("episode_id"),
        "label",
        F.col("pr").cast("double").alias("step"),
        (F.col("pr") / 5.0).alias("prefix_time_s"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp_s"),
        share(F.col("wu")).alias("p_user"),
        share(F.col("wa")).alias("p_assist"),
        "dk",
    )


def by_split(rows: DataFrame) -> DataFrame:
    """Base traces, or what was made of them, once for each split family: leave one subject out, and forward by day."""
    logo, forward = F.concat(F.lit("logo|"), "subject_id"), F.concat(F.lit("forward_day|"), "day")
    return rows.withColumn("split_id", F.explode(F.when(F.col("dk") > 0, F.array(logo, forward)).otherwise(F.array(logo)))).drop("dk")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_split(base_traces(spark, sf_dir))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long signal per user: sample number, time, value, label (event type, 0 is rest) and an invalid mark."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    # named before the window, so that what groups by record later finds its rows dealt
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "record_id")
    return e.select(
        "record_id",
        (F.row_number().over(Window.partitionBy("record_id").orderBy("ts", "event_id")) - 1).cast("long").alias("t"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"),
        (F.col("value") - 50).alias("value"),
        F.coalesce(F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type")) - 1, F.lit(0)).cast("int").alias("label"),
        (F.col("event_id") % 11 == 0).alias("invalid"),
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: subject, group, session (year), day (month) and raw label."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("row_id"),
        (F.col("o_custkey") % 50).alias("subject_id"),
        F.col("c_mktsegment").alias("group"),
        F.year("o_orderdate").alias("session"),
        F.concat(F.lit("day"), F.month("o_orderdate").cast("string")).alias("day"),
        F.col("o_orderpriority").alias("label_raw"),
        F.col("o_totalprice").alias("value"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("features"))


def unit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier and return flag: a metric, and the budget it was reached at."""
    u = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag")
    return u.agg(F.avg("l_discount").alias("metric"), F.avg("l_tax").alias("budget"), F.count(F.lit(1)).alias("n")).select(F.col("l_suppkey").alias("unit"), F.col("l_returnflag").alias("policy"), "metric", "budget", "n")


#: Samples of one row of sequences().
SEQUENCE = 16


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per full block of a signal: six modalities as time x channel arrays with masks, tabular features, and
    a label that only the order inside the block tells (whether its last quarter lies above its first)."""
    s = samples(spark, sf_dir)
    one = lambda *c: F.array(*[x.cast("double") for x in c])
    kind, ok = lambda x: x["label"].cast("double"), lambda x: (~x["invalid"]).cast("double")
    channels = {
        "emg": lambda x: one(x["value"], kind(x)),
        "time_mask": ok,
        "gaze": lambda x: one(x["t"] % 7, x["t"] % 5),
        "gaze_mask": lambda x: (x["t"] % 3 != 0).cast("double"),
        "pupil": lambda x: one(x["value"] * 2),
        "pupil_mask": lambda x: one(ok(x), (x["t"] % 2 == 0).cast("double")),
        "acc": lambda x: one(x["value"], -x["value"], kind(x)),
        "acc_mask": lambda x: (x["t"] % 4 < 3).cast("double"),
        "gyr": lambda x: one(kind(x) * x["value"]),
        "gyr_mask": lambda x: (F.col("record_id") % 2).cast("double"),
        "context": lambda x: one(x["t"] % 2),
        "context_mask": lambda x: F.lit(1.0),
    }
    # samples are collected as they are; the modalities are made of the sorted block
    step = F.struct("t", "value", "label", "invalid")
    blocks = s.groupBy("record_id", F.floor(F.col("t") / SEQUENCE).alias("block")).agg(F.collect_list(step).alias("s"), F.count_if(F.col("label") > 0).alias("moves"))
    blocks = blocks.where(F.size("s") == SEQUENCE).withColumn("s", F.sort_array("s"))
    quarter = lambda a, b: F.aggregate(F.filter("s", lambda x: (x["t"] % SEQUENCE >= a) & (x["t"] % SEQUENCE < b)), F.lit(0.0), lambda acc, x: acc + x["value"].cast("double"))
    return blocks.select(
        (F.col("record_id") * 100_000 + F.col("block")).alias("row_id"),
        (quarter(12, 16) > quarter(0, 4)).cast("int").alias("label"),
        F.array(F.col("moves").cast("double"), (F.col("record_id") % 3).cast("double")).alias("features"),
        *[F.transform("s", f).alias(f"assist_{n}") for n, f in channels.items()],
    )
