"""Exact running sums and quantiles of groups that may hold most of all rows.

A value's place between the least and the largest of its group is cut into digits of
BITS bits. Counts by digit are added on the map side, and prefix sums run over at most
2^BITS of them at a time, from the first digit to the last; only values that agree in
all digits are ordered by themselves. Places grow with values (logarithms keep far
values from crowding the rest into one place), so results are exact, ties included.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS, LEVELS = 11, 3
#: Quantiles times groups that exact_quantiles() takes.
MOST_TARGETS = 1_000_000
#: Rows that agree in all digits so far, at most, for them to be ordered by themselves.
FEW = 10_000


def _spread(v: Column) -> Column:
    return F.signum(v) * F.log1p(F.abs(v))


def _place(v: Column, low: Column, high: Column, level: int) -> Column:
    """Leading digits, as many as level, of a value's place in its group."""
    share = F.when(high > low, (_spread(v) - _spread(low)) / (_spread(high) - _spread(low))).otherwise(0.0)
    return F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * float(1 << (BITS * level)))


def running_sums(df: DataFrame, by: list[str], value: str, amounts: list[str]) -> DataFrame:
    """df with, for each amount a, a_upto (its sum over the group's rows of values not above) and a_all (over the group).

    Each value occurs once in its group. Windows hold at most 2^BITS rows, or rows that
    agree in all digits.
    """
    ends = df.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), *[F.sum(a).alias(f"{a}_all") for a in amounts])
    joined = df.join(ends, by) if by else df.crossJoin(F.broadcast(ends))
    placed = joined.withColumns({f"_d{k}": _place(F.col(value), F.col("_low"), F.col("_high"), k) for k in range(1, LEVELS + 1)})
    digits = [f"_d{k}" for k in range(1, LEVELS + 1)]
    tables = [placed.groupBy(*by, *digits[:k]).agg(*[F.sum(a).alias(a) for a in amounts]) for k in range(1, LEVELS + 1)]
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    base: DataFrame | None = None
    for k, t in enumerate(tables, 1):
        keys = [*by, *digits[: k - 1]]
        own = {f"_b_{a}": F.coalesce(F.sum(a).over(before(keys, digits[k - 1])), F.lit(0)) for a in amounts}
        if base is not None:
            t = t.join(base, keys)
            own = {f"_b_{a}": F.col(f"_a_{a}") + e for a, e in zip(amounts, own.values(), strict=True)}
        base = t.withColumns(own).select(*by, *digits[:k], *[F.col(f"_b_{a}").alias(f"_a_{a}") for a in amounts])
    w = Window.partitionBy(*by, *digits).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(base, [*by, *digits])
    return out.withColumns({f"{a}_upto": F.col(f"_a_{a}") + F.sum(a).over(w) for a in amounts}).drop("_low", "_high", *digits, *[f"_a_{a}" for a in amounts])


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> dict[tuple, list[float]]:
    """Linear quantiles of each group's values, neither null nor NaN, by a fixed number of passes over df.

    A pass counts, within the digits found so far, the next digit; rows are never
    shuffled, only counts. The last pass orders the values that agree in all digits, once
    no wanted place holds more than FEW rows or the digits are used up. Groups times
    shares are checked, as they pass the driver.
    """
    spark = df.sparkSession
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    ends = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    found = ends.limit(MOST_TARGETS // len(shares) + 1).collect()
    if len(found) * len(shares) > MOST_TARGETS:
        raise ValueError("too many groups for exact quantiles")
    if not found:
        return {}
    kinds = [df.schema[c] for c in by]
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kinds)
    group = lambda r: tuple(r[c] for c in by)
    limits = F.broadcast(spark.createDataFrame([(*group(r), r["_low"], r["_high"]) for r in found], f"{types}_low double, _high double"))
    same = lambda a, names: [F.col(c).eqNullSafe(F.col(f"{a}_{k}")) for k, c in enumerate(names)]

    def meet(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
        """Join on names, nulls being equal."""
        right = right.select(*[F.col(c).alias(f"_r_{k}") for k, c in enumerate(names)], *[c for c in right.columns if c not in names])
        tests = same("_r", names)
        test = tests[0] if tests else F.lit(True)
        for x in tests[1:]:
            test = test & x
        return left.join(F.broadcast(right), test).drop(*[f"_r_{k}" for k in range(len(names))])

    rows = meet(rows, limits, by)
    wanted = {group(r): sorted({k for s in shares for k in (floor(s * (r["n"] - 1)), min(floor(s * (r["n"] - 1)) + 1, r["n"] - 1))}) for r in found}
    # where each wanted rank lies: digits so far, and its rank among the values that share them
    at = {(g, rank): (0, rank) for g, ranks in wanted.items() for rank in ranks}
    last = 0
    for level in range(1, LEVELS + 1):
        near = rows.withColumn("_up", _place(F.col("_v"), F.col("_low"), F.col("_high"), level - 1) if level > 1 else F.lit(0).cast("long")).withColumn("_digit", _place(F.col("_v"), F.col("_low"), F.col("_high"), level))
        live = spark.createDataFrame(sorted({(*g, d) for (g, _), (d, _) in at.items()}, key=str), f"{types}_up long")
        counts = meet(near, live, [*by, "_up"]).groupBy(*by, "_up", "_digit").agg(F.count(F.lit(1)).alias("c"))
        upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*by, "_up").orderBy("_digit")))
        asked = spark.createDataFrame([(*g, d, rank, left) for (g, rank), (d, left) in at.items()], f"{types}_up long, rank long, left long")
        hit = meet(upto, asked, [*by, "_up"]).where("left < upto and left >= upto - c")
        got = hit.collect()
        at, last = {(group(r), r["rank"]): (r["_digit"], r["left"] - r["upto"] + r["c"]) for r in got}, level
        if max(r["c"] for r in got) <= FEW:
            break
    near = rows.withColumn("_up", _place(F.col("_v"), F.col("_low"), F.col("_high"), last))
    live = spark.createDataFrame(sorted({(*g, d) for (g, _), (d, _) in at.items()}, key=str), f"{types}_up long")
    counts = meet(near, live, [*by, "_up"]).groupBy(*by, "_up", "_v").agg(F.count(F.lit(1)).alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*by, "_up").orderBy("_v")))
    asked = spark.createDataFrame([(*g, d, rank, left) for (g, rank), (d, left) in at.items()], f"{types}_up long, rank long, left long")
    hit = meet(upto, asked, [*by, "_up"]).where("left < upto and left >= upto - c")
    values = {(group(r), r["rank"]): r["_v"] for r in hit.collect()}
    out = {}
    for r in found:
        own = []
        for s in shares:
            place = s * (r["n"] - 1)
            low = floor(place)
            a, b = values[group(r), low], values[group(r), min(low + 1, r["n"] - 1)]
            own.append(a if a == b else a + (b - a) * (place - low))
        out[group(r)] = own
    return out
