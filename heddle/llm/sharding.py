"""Sharding along a Hilbert curve.

Several metadata columns are quantised to 2^bits levels each by quantiles
(approximate ones of numbers, counted ones of strings): a value's level is the
middle of its rows' ranks, as a share of all rows, times 2^bits. So a column of few
values still spreads over all levels, and the curve's first bits part it. A row's cell has a place
on the Hilbert curve through that grid; rows are ordered along the curve and the
order is cut into runs of equal counts (law `rows`: counts at most one apart). A
shard then covers a small box of the grid, and readers skip shards by the ranges
of several columns at once.

Exact ranks take no global sort: rows are counted by cell and salt (groups of
about GROUP_ROWS rows), prefix sums over those counts give each group's first rank, and
rows are numbered inside their group. Inside a cell equal texts lie together,
unless a cut falls between them; only a text with many rows in a cell is dealt on
by id, inside its own run.

Defined cases: null texts have no bytes and size 1; null metadata has level 0;
repeated rows and null ids each get their own slot. Ids may be of any type that can be
ordered; a text's length doesn't matter, since only its size and checksum are shuffled
(write_shards() shuffles the rows themselves). Columns of the caller may have any name:
write_shards() names the shard's column `_shard`, with more underscores where that is taken.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import fresh, materialize

#: Rows of a group: a cell's rows are dealt into such groups by their text.
GROUP_ROWS = 50_000
#: A text with more rows in a cell than this, and than this share of all rows, is dealt by id; no more than 1 / HOT_SHARE texts are.
HOT_ROWS, HOT_SHARE = 10_000, 1 / 2000
#: Bits of a curve index, which bounds the number of cells.
MOST_BITS = 20


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of integer coordinates (n x d) on the Hilbert curve of order bits.

    Gray-code construction over all rows at once: undo the rotations from the
    highest bit down, then interleave.
    """
    x = coords.astype(np.int64).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = np.where(high, x[i], x[i] ^ swap)
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
    x ^= flip
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | (x[i] >> level & 1)
    return out


def _is_text(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.simpleString() == "string"


def _value(df: DataFrame, name: str) -> Column:
    return F.col(name) if _is_text(df, name) else F.col(name).cast("double")


def text_levels(df: DataFrame, name: str, bits: int) -> list[str]:
    """Quantiles of a string column from its counted values, which are ordered over all tasks."""
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    parts = materialize(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "strings")
    sums = parts.groupBy("part").agg(F.sum("n").alias("s"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("s").over(before), F.lit(0))).withColumn("total", F.sum("s").over(Window.partitionBy()))
    own = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = parts.withColumn("upto", F.sum("n").over(own)).join(F.broadcast(sums), "part").withColumn("upto", F.col("upto") + F.col("base"))
    got = upto.agg(*[F.min(F.when(F.col("upto") * 2**bits >= F.col("total") * k, F.col("v"))).alias(f"q{k}") for k in range(1, 2**bits)]).first()
    return [x for x in got if x is not None]


def levels(df: DataFrame, names: list[str], bits: int) -> dict[str, list]:
    """Cut points of each column, 2^bits - 1 in rising order, equal ones kept; all numbers from one pass of approximate quantiles."""
    share = [k / 2**bits for k in range(1, 2**bits)]
    out: dict[str, list] = {c: text_levels(df, c, bits) for c in names if _is_text(df, c)}
    numbers = [c for c in names if c not in out]
    if numbers:
        got = df.agg(*[F.percentile_approx(_value(df, c), share, 2000).alias(f"q{i}") for i, c in enumerate(numbers)]).first()
        out |= {c: [float(x) for x in got[f"q{i}"] or []] for i, c in enumerate(numbers)}
    return out


def hilbert_column(df: DataFrame, names: list[str], cuts: dict[str, list], bits: int) -> Column:
    """Curve index of a row from its quantised columns."""

    @F.pandas_udf("long")
    def place(*cols: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cols], axis=1), bits))

    def level(c: str) -> Column:
        # halfway between the cut points below the value and those not above it; null: 0
        points = F.array(*[F.lit(x) for x in cuts[c]]) if cuts[c] else F.array().cast("array<string>" if _is_text(df, c) else "array<double>")
        v = _value(df, c)
        below, upto = F.size(F.filter(points, lambda p: p < v)), F.size(F.filter(points, lambda p: p <= v))
        return F.when(v.isNull(), 0).otherwise(F.floor((below + upto) / 2)).cast("int")

    return place(*[level(c) for c in names])


def assign(docs: DataFrame, dims: list[str], shards: int = 16, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, curve index, rank along the curve, shard, slot.

    The text itself takes no part in any shuffle.
    """
    return _assigned(docs, dims, shards, bits, id_col, text_col, []).select("doc_id", "size", "text_crc32", F.col("cell").alias("curve"), F.col("rank").cast("long").alias("rank"), "shard", "slot")


def _assigned(docs: DataFrame, dims: list[str], shards: int, bits: int, id_col: str, text_col: str, more: list[Column]) -> DataFrame:
    if bits * len(dims) > MOST_BITS:
        raise ValueError(f"bits times dimensions must be at most {MOST_BITS}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    cuts = levels(docs, dims, bits)
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        hilbert_column(docs, dims, cuts, bits).alias("cell"),
        *more,
    )
    keyed = materialize(keyed, "cells")
    total = keyed.count()
    per, extra = divmod(total, shards)
    groups_of = lambda n: F.ceil(F.col(n) / GROUP_ROWS)
    # at most 2^MOST_BITS cells and 1 / HOT_SHARE texts: both may be broadcast
    cells = keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("cell", "cell_base", groups_of("n").alias("parts"))
    least = max(HOT_ROWS, int(total * HOT_SHARE))
    hot = keyed.groupBy("cell", "text_crc32").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("cell", "text_crc32", groups_of("n").alias("own_parts"))
    keyed = keyed.join(F.broadcast(cells), "cell").join(F.broadcast(hot), ["cell", "text_crc32"], "left")
    # a text of many rows has groups of its own, after all others, and is dealt by id; other texts share groups, ordered by checksum
    by_id = F.shiftleft(F.col("text_crc32") + 1, 30) + F.pmod(F.xxhash64("doc_id", "size"), F.col("own_parts"))
    keyed = keyed.withColumn("salt", F.when(F.col("own_parts").isNotNull(), by_id).otherwise(F.pmod("text_crc32", "parts")))
    groups = keyed.groupBy("cell", "salt").agg(F.count(F.lit(1)).alias("n"), F.first("cell_base").alias("cell_base"))
    inside = Window.partitionBy("cell").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = groups.select("cell", "salt", (F.col("cell_base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("base"))
    own = Window.partitionBy("cell", "salt").orderBy("text_crc32", "doc_id", "size")
    ranked = keyed.withColumn("k", F.row_number().over(own) - 1).join(base, ["cell", "salt"]).withColumn("rank", F.col("base") + F.col("k"))
    # the first `extra` shards hold per + 1 rows
    edge, r = extra * (per + 1), F.col("rank")
    shard = F.when(r < edge, F.floor(r / (per + 1))).otherwise(extra + F.floor((r - edge) / max(per, 1))).cast("int")
    first = F.when(F.col("shard") < extra, F.col("shard") * (per + 1)).otherwise(edge + (F.col("shard") - extra) * per)
    return ranked.withColumn("shard", shard).withColumn("slot", (r - first).cast("long"))


def write_shards(docs: DataFrame, path: str, dims: list[str], shards: int = 16, bits: int = 4, id_col: str = "doc_id", text_col: str = "text", rows_per_file: int = 100_000) -> None:
    """Write docs as Parquet, one folder per shard of assign(), rows in the order of their slots, about so many a file."""
    name = fresh(docs, "_shard")
    placed = _assigned(docs, dims, shards, bits, id_col, text_col, [F.struct(*docs.columns).alias("row")])
    file, slot = fresh(docs, "_file"), fresh(docs, "_slot")
    placed = placed.select("row.*", F.col("shard").alias(name), F.col("slot").alias(slot), F.floor(F.col("slot") / rows_per_file).alias(file))
    placed.repartition(name, file).sortWithinPartitions(name, slot).drop(slot, file).write.partitionBy(name).parquet(path)


def ranges(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Smallest and largest value of each column in each shard: what a reader prunes by."""
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in dims for n, f in (("min", F.min), ("max", F.max))])
