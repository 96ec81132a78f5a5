"""Extremely randomized trees: all trees grow at once, a level at a time, over rows that stay distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.sources.store import scratch, stored

#: (vector, tree) pairs that grow together; more are dealt over blocks of trees.
PAIRS = 20_000_000

#: A feature whose values in a node differ by no more is constant there.
CONSTANT = 1e-7


def _total(xs) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, y: acc + y)


def _draw(*key) -> Column:
    """A number in [0, 1) that follows from the key."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 52)) / float(1 << 52)


def _cuts(width: int, tried: int, seed: int) -> Column:
    """(feature, cut) of the features drawn for a node: constant ones count as drawn, but one that isn't is found if there is any."""
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda f: F.struct(_draw("tree", "node", f, F.lit(seed)).alias("h"), f.alias("f"))))
    varies = lambda s: F.col("high")[s["f"]] > F.col("low")[s["f"]] + CONSTANT
    drawn, any_ = F.filter(F.slice(order, 1, tried), varies), F.slice(F.filter(order, varies), 1, 1)

    def cut(s):
        low, high = F.col("low")[s["f"]], F.col("high")[s["f"]]
        at = low + _draw("tree", "node", s["f"], F.lit(seed), F.lit("cut")) * (high - low)
        return F.struct(s["f"].alias("f"), F.when(at >= high, low).otherwise(at).alias("cut"))

    return F.transform(F.when(F.size(drawn) > 0, drawn).otherwise(any_), cut)


def _purity(left: list[Column], right: list[Column]) -> Column:
    """What Gini's impurity leaves of both sides: the larger, the purer."""
    side = lambda xs: sum(x * x for x in xs) / sum(xs)
    return side(left) + side(right)


def extra_trees(train: DataFrame, rest: DataFrame, classes: int, width: int, trees: int = 512, seed: int = 7) -> DataFrame:
    """rest's columns without x, and p: the mean over trees of the weighted shares of classes in its leaf.

    train: x (array), label, weight; rest: x and any columns. Every tree has all training
    rows. A node draws sqrt(width) features, cuts each at a random place between its least
    and largest value there, and takes the purest; it is a leaf where it holds one class or
    equal vectors. Equal vectors are one, with the weights of their classes; those of the
    rest go down the trees beside the training ones, without weight.
    """
    tried = max(1, int(width**0.5))
    w = [F.coalesce(F.sum(F.when(F.col("label") == k, F.col("weight"))), F.lit(0.0)) for k in range(classes)]
    both = train.select("x", "label", "weight").unionByName(rest.select("x"), allowMissingColumns=True)
    vectors = stored(both.groupBy("x").agg(F.array(*w).alias("w")).withColumn("v", F.monotonically_increasing_id()), "vectors")
    block = max(1, PAIRS // max(1, vectors.count()))
    trained, ks, js = _total("w") > 0, range(classes), range(tried)
    leaves = scratch(train.sparkSession, "leaves")

    for first in range(0, trees, block):
        each = F.explode(F.sequence(F.lit(first), F.lit(min(trees, first + block) - 1))).alias("tree")
        at = stored(vectors.select("v", "x", "w", each, F.lit(0).cast("long").alias("node")), "level")
        while not at.isEmpty():
            ends = [F.array(*[g(F.col("x")[f]) for f in range(width)]).alias(n) for g, n in ((F.min, "low"), (F.max, "high"))]
            nodes = at.where(trained).groupBy("tree", "node").agg(*ends, F.array(*[F.sum(F.col("w")[k]) for k in ks]).alias("total"))
            nodes = nodes.withColumn("cuts", F.when(F.size(F.filter("total", lambda y: y > 0)) > 1, _cuts(width, tried, seed)).otherwise(F.array())).drop("low", "high")
            level = stored(at.join(nodes, ["tree", "node"]), "nodes")
            ended = level.where(F.size("cuts") == 0)
            ended.select("v", F.transform("total", lambda y: y / _total("total")).alias("p")).write.mode("append").parquet(leaves)
            grows = level.where(F.size("cuts") > 0)
            below = lambda c: F.col("x")[c["f"]] <= c["cut"]
            left = [F.sum(F.when(below(F.get("cuts", F.lit(j))), F.col("w")[k]).otherwise(0.0)).alias(f"l{j}_{k}") for j in js for k in ks]
            sums = grows.where(trained).groupBy("tree", "node").agg(*left, F.any_value("cuts").alias("cuts"), F.any_value("total").alias("total"))
            score = [F.when(F.size("cuts") > j, F.struct(_purity([F.col(f"l{j}_{k}") for k in ks], [F.col("total")[k] - F.col(f"l{j}_{k}") for k in ks]).alias("s"), F.lit(-j).alias("j"))) for j in js]
            best = sums.select("tree", "node", F.get("cuts", -F.array_max(F.array(*score))["j"]).alias("best"))
            goes = grows.join(best, ["tree", "node"]).select("v", "x", "w", "tree", F.xxhash64("node", below(F.col("best"))).alias("node"))
            at = stored(goes, "level")

    p = train.sparkSession.read.schema("v long, p array<double>").parquet(leaves).groupBy("v").agg(F.array(*[F.avg(F.col("p")[k]) for k in ks]).alias("p"))
    scored = vectors.join(p, "v").select("x", "p")
    return rest.join(scored, "x").drop("x")
