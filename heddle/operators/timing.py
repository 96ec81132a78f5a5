"""Earliest prefix times at which a policy helps, is right, is safe, and stays so."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPISODE = ["dataset_id", "split_id", "policy", "subject_id", "session", "day", "episode_id"]
UNIT = EPISODE[:-1]


def stable_future(df: DataFrame, key: str = "event_id") -> DataFrame:
    """Adds final_action and stable: this and all later actions of the episode equal the final one."""
    w = Window.partitionBy(*EPISODE).orderBy("prefix_time_s", "timestamp_s", key)
    final = F.last("selected_action").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = df.withColumn("final_action", final)
    return df.withColumn("stable", F.min((F.col("selected_action") == F.col("final_action")).cast("int")).over(w.rowsBetween(0, Window.unboundedFollowing)) == 1)


def earliest_by_episode(decisions: DataFrame, key: str = "event_id") -> DataFrame:
    """One row per episode and policy; a time is null where the event never happens."""
    df = stable_future(decisions, key)
    safe = F.col("intervene") & F.col("correct") & (F.col("expected_ali") <= F.col("tau") + 1e-12)
    settled = safe & F.col("stable") & (F.col("final_action") == F.col("label"))
    first = lambda test: F.min(F.when(test, F.col("prefix_time_s")))
    return df.groupBy(*EPISODE).agg(
        F.count(F.lit(1)).alias("n_prefixes"),
        F.first("final_action").alias("final_action"),
        first(F.col("intervene")).alias("earliest_intervention_s"),
        first(F.col("correct")).alias("earliest_correct_s"),
        first(safe).alias("earliest_safe_s"),
        first(settled).alias("earliest_stable_safe_s"),
    )


TIMES = ["earliest_intervention_s", "earliest_correct_s", "earliest_safe_s", "earliest_stable_safe_s"]


def earliest_by_unit(episodes: DataFrame, unit: list[str] | None = None) -> DataFrame:
    return episodes.groupBy(*(unit or UNIT)).agg(F.count(F.lit(1)).alias("n_episodes"), *[F.avg(F.col(t).isNotNull().cast("double")).alias(t.replace("earliest_", "rate_").removesuffix("_s")) for t in TIMES], *[F.median(t).alias(f"median_{t}") for t in TIMES])


def earliest_aggregate(units: DataFrame) -> DataFrame:
    """Means by family and policy; missing medians are left out."""
    values = [c for c in units.columns if c.startswith(("rate_", "median_"))]
    family = F.split_part("split_id", F.lit("|"), F.lit(1))
    return units.groupBy("dataset_id", family.alias("split_family"), "policy").agg(F.sum("n_episodes").alias("n_episodes"), *[F.avg(c).alias(c) for c in values])
