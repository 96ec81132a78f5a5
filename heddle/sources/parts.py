"""A prepared table kept in parts: fresh parts stay, stale ones are made again, versions are swapped in whole.

Below the root lie `runs/run=<n>/part=<p>/` with the rows of the parts that run n made,
and `versions/<n>/`, one row per part: its fingerprint, the run that holds it and its
rows. A version is written under another name and renamed once complete; until then
readers see the one before. Nothing that a version names is ever changed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "part string, fingerprint string, run long, rows long"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def current_version(spark: SparkSession, root: str) -> int:
    """The highest complete version; 0 where there is none."""
    fs, at = _fs(spark, f"{root}/versions")
    if not fs.exists(at):
        return 0
    names = [x.getPath().getName() for x in fs.listStatus(at)]
    return max([int(n) for n in names if n.isdigit()], default=0)


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """part, fingerprint, run, rows of a version, the current one by default."""
    version = current_version(spark, root) if version is None else version
    if not version:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/versions/{version:09d}")


def read_parts(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The merged rows of a version's parts, with their part; parts of other runs aren't read."""
    listed = manifest(spark, root, version)
    runs = [r[0] for r in listed.where("rows > 0").select("run").distinct().orderBy("run").collect()]
    if not runs:
        raise ValueError(f"no rows in {root}")
    at = f"{root}/runs"
    found = spark.read.option("basePath", at).parquet(*[f"{at}/run={r}" for r in runs])
    # as large as the number of parts; Spark prunes folders by it
    return found.withColumn("part", F.col("part").cast("string")).join(listed.select("run", "part"), ["run", "part"], "left_semi").drop("run")


def refresh_parts(spark: SparkSession, root: str, fingerprints: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Bring the table at root up to date; the progress: part, status, rows, version.

    fingerprints: part, fingerprint of all wanted parts (part_fingerprints() of their
    members; put what else decides a part's rows, such as a grid or a version of the
    code, into its fields). build: from a table of stale parts to their rows, with a
    column part. Parts whose fingerprint is unchanged are neither read nor written
    (status fresh); others are new or changed; parts no longer wanted are removed.
    Without a stale or removed part nothing is written at all.
    """
    before = current_version(spark, root)
    old = manifest(spark, root)
    want = fingerprints.select(F.col("part").cast("string").alias("part"), "fingerprint")
    seen = want.join(old.select("part", F.col("fingerprint").alias("was"), "run", "rows"), "part", "full")
    status = F.when(F.col("fingerprint").isNull(), "removed").when(F.col("was").isNull(), "new").when(F.col("was") == F.col("fingerprint"), "fresh").otherwise("changed")
    plan = seen.withColumn("status", status).persist()
    changed = {r["status"] for r in plan.select("status").distinct().collect()} - {"fresh"}
    stale = plan.where("status in ('new', 'changed')").select("part")
    if not changed:
        return plan.select("part", "status", "rows", F.lit(before).alias("version"))
    run = before + 1
    made = spark.createDataFrame([], "part string, made long")
    if changed - {"removed"}:
        # a broken run of the same number may have left rows
        out = f"{root}/runs/run={run}"
        build(stale).write.mode("overwrite").partitionBy("part").parquet(out)
        made = spark.read.parquet(out).groupBy(F.col("part").cast("string").alias("part")).agg(F.count(F.lit(1)).alias("made"))
    new = plan.where("status <> 'removed'").join(made, "part", "left")
    fresh = F.col("status") == "fresh"
    listed = new.select("part", "fingerprint", F.when(fresh, F.col("run")).otherwise(run).alias("run"), F.when(fresh, F.col("rows")).otherwise(F.coalesce("made", F.lit(0))).cast("long").alias("rows"))
    temporary = f"{root}/versions/_{uuid.uuid4().hex}"
    listed.write.parquet(temporary)
    fs, at = _fs(spark, temporary)
    if not fs.rename(at, _fs(spark, f"{root}/versions/{run:09d}")[1]):
        raise RuntimeError(f"another run made version {run}")
    after = manifest(spark, root, run).select("part", F.col("rows").alias("now"))
    return plan.join(after, "part", "left").select("part", "status", F.coalesce("now", F.lit(0)).alias("rows"), F.lit(run).alias("version"))


def drop_old_runs(spark: SparkSession, root: str) -> list[int]:
    """Remove the runs and versions that the current version doesn't name; readers of older versions lose them."""
    version = current_version(spark, root)
    kept = {r[0] for r in manifest(spark, root).select("run").distinct().collect()}
    fs, at = _fs(spark, f"{root}/runs")
    gone = []
    for x in fs.listStatus(at) if fs.exists(at) else []:
        run = int(x.getPath().getName().split("=")[1])
        if run not in kept:
            fs.delete(x.getPath(), True)
            gone.append(run)
    fs, at = _fs(spark, f"{root}/versions")
    for x in fs.listStatus(at) if fs.exists(at) else []:
        if x.getPath().getName() != f"{version:09d}":
            fs.delete(x.getPath(), True)
    return sorted(gone)
