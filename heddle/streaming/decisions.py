"""Policies on a stream, and the latest decision of each episode within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.policies import TAUS, policy_grid


def stream_decisions(traces: DataFrame, taus: tuple[float, ...] = TAUS) -> DataFrame:
    """The policy grid over a streaming DataFrame: stateless, one row per trace and policy."""
    return policy_grid(traces, taus)


def windowed_rates(decisions: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Intervention rate and accuracy by time window and policy; rows later than the watermark are left out."""
    return decisions.withWatermark(time, late).groupBy(F.window(time, window), "policy").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("intervene").cast("double")).alias("intervention_rate"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
