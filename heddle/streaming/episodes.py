"""Earliest times of episodes on a stream: timing.earliest_by_episode() with state and timers.

Rows of an episode may come in any order within the watermark. An episode is kept as the
few numbers of each of its rows; when the watermark has passed its last row by `gap`, its
result goes out once and its state is dropped. Later rows than the watermark are left out
by Spark before they come here.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from heddle.operators.timing import EPISODE, TIMES

#: What is kept of a row; workers build it without a session.
KINDS = {"prefix_time_s": DoubleType(), "timestamp_s": DoubleType(), "event_id": LongType(), "selected_action": IntegerType(), "intervene": BooleanType(), "correct": BooleanType(), "safe": BooleanType(), "label": IntegerType()}
FIELDS = list(KINDS)
ROW = StructType([StructField(n, t) for n, t in KINDS.items()])
LAST = StructType([StructField("at", LongType())])


class Episodes(StatefulProcessor):
    """Rows by episode until its timer ends."""

    def __init__(self, gap_ms: int, time: str, names: list[str]):
        self.gap, self.time, self.names = gap_ms, time, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", ROW)
        self.last = handle.getValueState("last", LAST)

    def handleInputRows(self, key, rows, timerValues):
        end = self.last.get()[0] if self.last.exists() else None
        latest = end or 0
        for df in rows:
            self.rows.appendList([tuple(r) for r in df[FIELDS].astype(object).itertuples(index=False)])
            latest = max(latest, int(df[self.time].max().value // 1_000_000))
        if latest != end:
            if end is not None:
                self.handle.deleteTimer(end + self.gap)
            self.handle.registerTimer(latest + self.gap)
            self.last.update((latest,))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        df = pd.DataFrame(list(self.rows.get()), columns=FIELDS).sort_values(["prefix_time_s", "timestamp_s", "event_id"])
        self.rows.clear()
        self.last.clear()
        final = df["selected_action"].iloc[-1]
        stable = (df["selected_action"] == final)[::-1].cummin()[::-1]
        safe = df["safe"].astype(bool)
        settled = safe & stable & (df["label"] == final)
        first = lambda mask: df["prefix_time_s"][mask.astype(bool)].min() if mask.any() else None
        values = [first(df["intervene"]), first(df["correct"]), first(safe), first(settled)]
        yield pd.DataFrame([[*key, len(df), int(final), *values]], columns=[*self.names, "n_prefixes", "final_action", *TIMES])

    def close(self) -> None:
        pass


def stream_episodes(decisions: DataFrame, time: str = "event_time", late: str = "10 minutes", gap_ms: int = 60_000) -> DataFrame:
    """One row per episode and policy, as earliest_by_episode() gives, once the episode is over.

    decisions: streaming, with a timestamp column `time`. The session's state store must
    be RocksDB's (spark.sql.streaming.stateStore.providerClass).
    """
    safe = F.col("intervene") & F.col("correct") & (F.col("expected_ali") <= F.col("tau") + 1e-12)
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("<missing>")).alias(c) for c in EPISODE]
    d = decisions.withColumn("safe", safe).select(time, *keys, *[F.col(c).cast(t).alias(c) for c, t in KINDS.items()])
    out = ", ".join(f"{c} string" for c in EPISODE) + ", n_prefixes long, final_action int, " + ", ".join(f"{t} double" for t in TIMES)
    return d.withWatermark(time, late).groupBy(*EPISODE).transformWithStateInPandas(Episodes(gap_ms, time, EPISODE), out, "Append", "EventTime")
