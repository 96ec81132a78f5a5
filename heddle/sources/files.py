"""Sources and sinks: traces, prepared tables, paths, sidecars, file inventories and parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRACE_COLUMNS = ("dataset_id", "split_id", "subject_id", "session", "timestamp_s", "label", "p_user", "p_assist")


def require_columns(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    absent = [c for c in names if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    return df


def parse_traces(df: DataFrame) -> DataFrame:
    """Vectors from JSON text where needed, an empty day as null, temperatures 1 where absent."""
    df = require_columns(df, TRACE_COLUMNS)
    for c in ("p_user", "p_assist"):
        if dict(df.dtypes)[c] == "string":
            df = df.withColumn(c, F.from_json(c, "array<double>"))
    df = df.withColumn("day", F.when(F.trim("day") != "", F.col("day")) if "day" in df.columns else F.lit(None).cast("string"))
    for c in ("user_temperature", "assist_temperature"):
        df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(1.0)) if c in df.columns else F.lit(1.0))
    return df.withColumns({"label": F.col("label").cast("int"), "timestamp_s": F.col("timestamp_s").cast("double")})


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces from Parquet, or from CSV with vectors as JSON text."""
    if path.rstrip("/").endswith(".csv"):
        return parse_traces(spark.read.option("header", True).option("escape", '"').csv(path))
    return parse_traces(spark.read.parquet(path))


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """csv (arrays as JSON text), json or parquet."""
    if fmt == "csv":
        nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
        df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif fmt in ("json", "parquet"):
        getattr(df.write.mode("overwrite"), fmt)(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def write_prepared(df: DataFrame, path: str) -> None:
    """The table, and beside it the number of its rows, which read_prepared() checks."""
    df.write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").json(path.rstrip("/") + ".rows")


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    """A prepared table; one without Spark's own success marker, or with other rows than were written, is incomplete."""
    fs = spark._jvm.org.apache.hadoop.fs
    marker = fs.Path(path.rstrip("/") + "/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        raise ValueError(f"{path} is incomplete")
    out = spark.read.parquet(path)
    noted = fs.Path(path.rstrip("/") + ".rows")
    if noted.getFileSystem(spark._jsc.hadoopConfiguration()).exists(noted):
        want = spark.read.schema("rows long").json(path.rstrip("/") + ".rows").first()["rows"]
        if out.count() != want:
            raise ValueError(f"{path} has not the {want} rows that were written")
    return out


def path_manifest(paths: DataFrame, column: str, pattern: str, names: list[str]) -> DataFrame:
    """Dimensions parsed from paths by a pattern's groups; paths that don't match are left out (unmatched_paths() tells them)."""
    return path_manifests(paths, column, [pattern], names).drop("pattern")


def path_manifests(paths: DataFrame, column: str, patterns: list[str], names: list[str]) -> DataFrame:
    """The same by the first of several patterns that matches, whose number is `pattern`."""
    fits = F.coalesce(*[F.when(F.col(column).rlike(p), k) for k, p in enumerate(patterns)])
    part = lambda n: F.coalesce(*[F.when(F.col("pattern") == k, F.regexp_extract(column, p, n + 1)) for k, p in enumerate(patterns)])
    hit = paths.select(F.col(column), fits.alias("pattern")).where("pattern is not null").distinct()
    return hit.select(column, "pattern", *[part(n).alias(name) for n, name in enumerate(names)])


def unmatched_paths(paths: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """The distinct paths that fit none of the patterns; a null path fits none."""
    fits = F.lit(False)
    for p in patterns:
        fits = fits | F.coalesce(F.col(column).rlike(p), F.lit(False))
    return paths.where(~fits).select(column).distinct()


def inconsistent_paths(paths: DataFrame, column: str, outer: str, inner: str) -> DataFrame:
    """path, outer, inner of paths whose two patterns (of directory and file name) both match but name different values."""
    a, b = F.regexp_extract(column, outer, 1), F.regexp_extract(column, inner, 1)
    return paths.select(F.col(column), a.alias("outer"), b.alias("inner")).where("`outer` <> '' and `inner` <> '' and `outer` <> `inner`").distinct()


def attach_sidecar(records: DataFrame, labels: DataFrame, key: str, ordinal: str, text: str, check: bool = True) -> DataFrame:
    """Labels from comma or line separated text, joined to records by their 1-based ordinal.

    Records without a label go; where the counts differ that is an error.
    """
    parts = labels.select(key, F.posexplode(F.filter(F.transform(F.split(text, "[,\n]"), F.trim), lambda x: x != "")).alias("_k", "label_raw")).withColumn("_k", F.col("_k") + 1)
    out = records.join(parts, (records[key] == parts[key]) & (records[ordinal] == F.col("_k"))).drop(parts[key]).drop("_k")
    if check:
        n = records.groupBy(key).agg(F.count(F.lit(1)).alias("a")).join(parts.groupBy(key).agg(F.count(F.lit(1)).alias("b")), key, "left")
        if n.where("not (a <=> b)").limit(1).count():
            raise ValueError("numbers of records and labels differ")
    return out


#: Bytes of a file that one task reads at a time for its digest.
RANGE_BYTES = 64 << 20


def _with_extension(f: DataFrame, *more: Column) -> DataFrame:
    return f.select("path", "size", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"), *more)


def _every_file(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The files that have content, as Spark reads them, and the path and size of those that are empty, which it leaves out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    names = f.inputFiles()
    one = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    every = spark.createDataFrame([(x,) for x in names], "path string").select(one(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))).alias("path"))
    full = f.withColumns({"path": one(F.col("path")), "size": F.col("length")})
    return full, every.join(full.select("path"), "path", "left_anti").withColumn("size", F.lit(0).cast("long"))


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """path, size, extension of every file below root; contents aren't read."""
    full, empty = _every_file(spark, root)
    return _with_extension(full.select("path", "size").unionByName(empty))


def _read_ranges(pieces: DataFrame, read: Callable[[bytes], dict], schema: str) -> DataFrame:
    """path, piece and read(bytes) of each range (path, piece, start, length) of local or shared files.

    Files are opened through pyarrow's file systems by the path's own scheme.
    """
    import pandas as pd

    def run(batches):
        from pyarrow import fs

        for b in batches:
            rows = []
            for path, piece, start, length in b[["path", "piece", "start", "length"]].itertuples(index=False):
                store, at = fs.FileSystem.from_uri(path.replace("file:///", "/").replace("file:/", "/") if path.startswith("file:") else path)
                with store.open_input_file(at) as f:
                    rows.append({"path": path, "piece": piece, **read(f.read_at(length, start))})
            yield pd.DataFrame(rows, columns=["path", "piece", *[x.split()[0] for x in schema.split(", ")]])

    return pieces.mapInPandas(run, f"path string, piece long, {schema}")


def _pieces(files: DataFrame, range_bytes: int) -> DataFrame:
    n = F.greatest(F.ceil(F.col("size") / range_bytes), F.lit(1))
    each = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("piece"))
    start = F.col("piece") * range_bytes
    return each.select("path", "piece", start.alias("start"), F.least(F.lit(range_bytes).cast("long"), F.col("size") - start).alias("length")).repartition("path", "piece")


def file_inventory(spark: SparkSession, root: str, digest: bool = True) -> DataFrame:
    """path, size, extension, sha256 of every file below root; without digests contents aren't read.

    A file is one row and is read whole by one task; tree_digests() has no such limit.
    """
    if not digest:
        return listed_files(spark, root)
    full, empty = _every_file(spark, root)
    digested = full.select("path", "size", F.sha2("content", 256).alias("sha256"))
    return _with_extension(digested.unionByName(empty.withColumn("sha256", F.sha2(F.lit(""), 256))), F.col("sha256"))


def tree_digests(files: DataFrame, leaf_bytes: int = 1 << 20, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, tree_sha256 of files (path, size) of any length.

    The digest is the SHA-256 of the digests (hex, joined) of the file's leaves of
    leaf_bytes in order, so ranges of a file are read by many tasks and the result
    doesn't depend on how long they are. A file's digests come together at the end: 64
    bytes for each leaf.
    """
    import hashlib

    if range_bytes % leaf_bytes:
        raise ValueError("ranges must hold whole leaves")

    def leaves(data: bytes) -> dict:
        return {"hashes": "".join(hashlib.sha256(data[k : k + leaf_bytes]).hexdigest() for k in range(0, max(len(data), 1), leaf_bytes))}

    each = _read_ranges(_pieces(files, range_bytes), leaves, "hashes string")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "hashes"))), lambda x: x["hashes"]), "")
    return each.groupBy("path").agg(F.sha2(joined, 256).alias("tree_sha256"))


def line_counts(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, lines, full (lines with more than white space) of text files (path, size), by ranges.

    What stands before a range's first line feed and after its last one is put together
    with its neighbours' ends: each says whether it holds more than white space.
    """

    def read(data: bytes) -> dict:
        parts = data.split(b"\n")
        return {"feeds": len(parts) - 1, "inner": sum(1 for x in parts[1:-1] if x.strip()), "head": bool(parts[0].strip()), "tail": bool(parts[-1].strip()), "rest": bool(parts[-1])}

    each = _read_ranges(_pieces(files, range_bytes), read, "feeds long, inner long, head boolean, tail boolean, rest boolean")
    w = Window.partitionBy("path").orderBy("piece")
    # a line that begins in a range ends at the next range with a line feed: runs of ranges up to one share a number
    run = F.coalesce(F.sum("feeds").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = each.withColumn("open", run).withColumn("last", F.max("piece").over(Window.partitionBy("path")))
    begun = marked.where("feeds > 0").select("path", (F.col("open") + F.col("feeds")).alias("open"), F.col("tail").alias("filled"))
    ends = marked.select("path", "open", F.col("head").alias("filled"))
    edges = begun.unionByName(ends).groupBy("path", "open").agg(F.max("filled").alias("filled"))
    full = edges.groupBy("path").agg(F.count_if("filled").alias("edge"))
    sums = marked.groupBy("path").agg(F.sum("feeds").alias("feeds"), F.sum("inner").alias("inner"), F.max(F.when(F.col("piece") == F.col("last"), F.col("rest"))).alias("rest"))
    return sums.join(full, "path").select("path", (F.col("feeds") + F.col("rest").cast("long")).alias("lines"), (F.col("inner") + F.col("edge")).alias("full"))


def extension_counts(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("extension").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def inventory_checks(inventory: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """check, passed: each rule is an aggregate over the inventory; an empty one passes none."""
    row = inventory.agg(F.count(F.lit(1)).alias("_n"), *[F.coalesce(r, F.lit(False)).alias(f"r{k}") for k, (_, r) in enumerate(rules)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(name).alias("check"), (F.col(f"r{k}") & (F.col("_n") > 0)).alias("passed")) for k, (name, _) in enumerate(rules)])).alias("x")).select("x.*")


#: Extensions of text that output_manifest() counts rows of, and the kind of each.
KINDS = {".csv": "table", ".json": "records", ".jsonl": "records", ".parquet": "table", ".md": "report", ".txt": "report", ".png": "figure", ".pdf": "figure"}


def output_manifest(spark: SparkSession, root: str, config: dict[str, str] | None = None, inputs: DataFrame | None = None) -> DataFrame:
    """path, kind, size, extension, tree_sha256, rows, and role (output; config or input where given), in order of role and path.

    rows: CSV lines without the header, JSON lines that aren't blank; only such files are
    read as text. config: names and texts, one record each, with their own SHA-256.
    inputs: path, size, sha256 of what the outputs were made from.
    """
    f = listed_files(spark, root)
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p]), F.col("extension")), F.lit("other"))
    lines = line_counts(f.where(F.col("extension").isin(".csv", ".json", ".jsonl")))
    rows = F.when(F.col("extension") == ".csv", F.greatest(F.col("lines") - 1, F.lit(0))).when(F.col("extension").isin(".json", ".jsonl"), F.col("full"))
    out = f.join(tree_digests(f), "path").join(lines, "path", "left").select(F.lit("output").alias("role"), "path", kind.alias("kind"), "size", "extension", F.col("tree_sha256").alias("sha256"), rows.alias("rows"))
    none = lambda t: F.lit(None).cast(t)
    if config:
        c = spark.createDataFrame(sorted(config.items()), "path string, text string")
        out = out.unionByName(c.select(F.lit("config").alias("role"), "path", F.lit("config").alias("kind"), F.octet_length("text").cast("long").alias("size"), none("string").alias("extension"), F.sha2("text", 256).alias("sha256"), none("long").alias("rows")))
    if inputs is not None:
        out = out.unionByName(inputs.select(F.lit("input").alias("role"), "path", F.lit("input").alias("kind"), "size", none("string").alias("extension"), "sha256", none("long").alias("rows")))
    return out.orderBy("role", "path")


def missing_files(expected: DataFrame, present: DataFrame, keys: list[str], suffixes: list[str]) -> DataFrame:
    """keys and suffix of the distinct expected files that aren't there."""
    want = expected.select(*keys).distinct().withColumn("suffix", F.explode(F.array(*map(F.lit, suffixes))))
    return want.join(present.select(*keys, "suffix").distinct(), [*keys, "suffix"], "left_anti")


def part_fingerprints(members: DataFrame, part: str, fields: list[str]) -> DataFrame:
    """part, fingerprint of its members' fields, whatever their order.

    Members are summed up as their number and the sums of four 32-bit parts of their
    hashes, so that no part is gathered in one task.
    """
    text = F.to_json(F.array(*[F.col(c).cast("string") for c in fields]))
    digest = members.select(part, F.sha2(text, 256).alias("h"))
    words = [F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)") for k in range(4)]
    each = digest.groupBy(part).agg(F.count(F.lit(1)).alias("n"), *[F.sum(w).cast("string").alias(f"w{k}") for k, w in enumerate(words)])
    return each.select(part, F.sha2(F.concat_ws(",", F.col("n").cast("string"), "w0", "w1", "w2", "w3"), 256).alias("fingerprint"))


def stale_parts(old: DataFrame, new: DataFrame, part: str) -> DataFrame:
    """Parts of new that are absent from old or whose fingerprint changed."""
    same = (new[part].eqNullSafe(old[part])) & (new.fingerprint.eqNullSafe(old.fingerprint))
    return new.join(old, same, "left_anti").select(part)


def merge_prepared(parts: list[DataFrame], features: str, sequences: str | None = None) -> DataFrame:
    """Union of prepared parts; feature arrays of different widths, or sequences (a map column) of different keys, are an error."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    checks = [F.min(F.size(features)).alias("a"), F.max(F.size(features)).alias("b")]
    if sequences:
        keys = F.array_join(F.array_sort(F.map_keys(sequences)), "|")
        checks += [F.min(keys).alias("k1"), F.max(keys).alias("k2"), F.count_if(F.col(sequences).isNull()).alias("none"), F.count(F.lit(1)).alias("n")]
    seen = out.agg(*checks).first()
    if seen["a"] != seen["b"]:
        raise ValueError(f"feature widths differ: {seen['a']} to {seen['b']}")
    if sequences and (seen["k1"] != seen["k2"] or 0 < seen["none"] < seen["n"]):
        raise ValueError(f"sequence keys differ: {seen['k1']} and {seen['k2']}")
    return out


def prepared_summary(df: DataFrame, features: str | None = None, sequences: str | None = None) -> DataFrame:
    """One row: rows, vocabulary, subjects, sessions, days; width of the features and keys of the sequences where named."""
    more = []
    if features:
        more.append(F.max(F.size(features)).alias("width"))
    if sequences:
        more.append(F.max(F.array_join(F.array_sort(F.map_keys(sequences)), "|")).alias("sequence_keys"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("label_raw").alias("vocabulary"), F.count_distinct("subject_id").alias("subjects"), F.count_distinct("session").alias("sessions"), F.count_distinct("day").alias("days"), *more)


def forbidden_scan(df: DataFrame, key: str, text: str, literals: DataFrame) -> DataFrame:
    """key, literal for rows whose text holds a forbidden literal (a short, broadcast list)."""
    p = literals.select(F.col(literals.columns[0]).alias("literal")).where("length(literal) > 0").distinct()
    return df.join(F.broadcast(p), F.contains(F.col(text), F.col("literal"))).select(key, "literal")


def forbidden_names(df: DataFrame, name: str, suffixes: list[str]) -> DataFrame:
    """name, suffix of distinct names that end in a blocked suffix, whatever its case."""
    ends = F.array_compact(F.array(*[F.when(F.lower(F.col(name)).endswith(x.lower()), x) for x in suffixes]))
    return df.select(name).distinct().select(name, F.explode(ends).alias("suffix"))


def missing_required(df: DataFrame, name: str, required: DataFrame) -> DataFrame:
    """The required names (one column) that no row bears."""
    want = required.select(F.col(required.columns[0]).alias(name)).distinct()
    return want.join(df.select(name).distinct(), name, "left_anti")


def latest(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last row of each group."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where("_k = 1").drop("_k")
