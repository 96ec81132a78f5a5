"""Cleaning, keys and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING = "<missing>"
UNIT = ("split_id", "subject_id", "session", "day")


def text_or_null(c: Column) -> Column:
    """Null for the tokens that stand for a missing text, whatever their case."""
    return F.when(F.lower(F.trim(c)).isin("", "nan", "none", "<na>"), None).otherwise(c)


def coerce_text(df: DataFrame, name: str, default_from: str | None = None, fill: str | None = None, prefix: str | None = None, key: str | None = None) -> DataFrame:
    """A string column without missing values: from a default column, a fill value, or prefix and row number by key."""
    options = [text_or_null(F.col(name).cast("string")) if name in df.columns else F.lit(None).cast("string")]
    if default_from:
        options.append(text_or_null(F.col(default_from).cast("string")))
    if fill is not None:
        options.append(F.lit(fill))
    if prefix is not None:
        options.append(F.concat(F.lit(prefix), F.lpad(F.col(key).cast("string"), 6, "0")))
    return df.withColumn(name, F.coalesce(*options))


def coerce_number(df: DataFrame, name: str, default_from: str | None = None, fill: float | None = None) -> DataFrame:
    cast = lambda c: F.expr(f"try_cast(`{c}` as double)")
    options = [cast(name), *([cast(default_from)] if default_from else []), *([F.lit(float(fill))] if fill is not None else [])]
    return df.withColumn(name, F.coalesce(*options))


def normalize_units(df: DataFrame, units: tuple[str, ...] = UNIT) -> DataFrame:
    """Unit columns as text, null as `<missing>`, absent columns added."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) if c in df.columns else F.lit(MISSING) for c in units})


def infer_units(df: DataFrame, units: tuple[str, ...] = UNIT) -> list[str]:
    """Unit columns that aren't missing everywhere; none is an error."""
    row = normalize_units(df, units).agg(*[F.max((F.col(c) != MISSING).cast("int")).alias(c) for c in units]).first()
    found = [c for c in units if row[c]]
    if not found:
        raise ValueError("no unit column holds values")
    return found


def apply_exclusions(df: DataFrame, excluded: DataFrame, key: str, enforce: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows not listed, and a report: listed, matched and unmatched entries, rows dropped.

    An empty list, and entries that match nothing, are errors unless enforce is off.
    """
    names = excluded.select(F.col(excluded.columns[0]).alias("_x")).distinct()
    kept = df.join(names, F.col(key) == F.col("_x"), "left_anti")
    hits = names.join(df.select(F.col(key).alias("_x")).groupBy("_x").agg(F.count(F.lit(1)).alias("n")), "_x", "left")
    report = hits.agg(F.count(F.lit(1)).alias("listed"), F.count("n").alias("matched"), F.sum(F.col("n").isNull().cast("long")).alias("unmatched"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_dropped"))
    if enforce:
        r = report.first()
        if not r.listed or r.unmatched:
            raise ValueError(f"exclusion list has {r.listed} entries, {r.unmatched} without a match")
    return kept, report


def index_labels(df: DataFrame, raw: str = "label_raw") -> DataFrame:
    """label: position of the raw label among the sorted distinct ones."""
    names = df.select(raw).where(F.col(raw).isNotNull()).distinct()
    indexed = names.withColumn("label", (F.row_number().over(Window.orderBy(raw)) - 1).cast("int"))
    return df.join(indexed, raw, "left")


def group_from_id(c: Column, threshold: int = 100) -> Column:
    """Group by the number in an id; an id without one raises."""
    n = F.regexp_extract(c, r"([0-9]+)", 1)
    return F.when(n == "", F.raise_error(F.concat(F.lit("no number in "), c)).cast("string")).when(n.cast("long") >= threshold, "amputee").otherwise("able_bodied")


def backfill_columns(df: DataFrame, mapping: dict[str, str], refuse: str | None = None) -> DataFrame:
    """Add absent columns as copies of their twins; where a column is absent, the dataset that needs values of its own is refused."""
    absent = {new: F.col(old) for new, old in mapping.items() if new not in df.columns}
    if absent and refuse and df.where(F.col("dataset_id") == refuse).limit(1).count():
        raise ValueError(f"{refuse} needs its own values")
    return df.withColumns(absent) if absent else df


def sampling_rate(samples: DataFrame, first: int = 4096, default: float = 2000.0) -> DataFrame:
    """record_id, rate: 1 / median of the positive gaps among a record's first stamps; under three stamps the default."""
    w = Window.partitionBy("record_id").orderBy("t")
    s = samples.where(F.col("t") < first).withColumn("gap", F.col("ts") - F.lag("ts").over(w))
    return s.groupBy("record_id").agg(F.when((F.count(F.lit(1)) < 3) | (F.count(F.when(F.col("gap") > 0, 1)) == 0), default).otherwise(1 / F.median(F.when(F.col("gap") > 0, F.col("gap")))).alias("rate"))
