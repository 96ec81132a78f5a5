"""Queries over orders, lineitem, events and text tables: keys, splits, signals, inference, sources, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import clean, inference, reports, scoring, splits
from heddle.operators import signal as sig
from heddle.plans import sql
from heddle.sources import files, parts, store, views

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def r6(df, *names: str):
    return df.withColumns({n: F.round(n, 6) for n in names})


# keys and cleaning


@query("b1_coerce_text", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'row_' || lpad(o_orderkey::VARCHAR, 6, '0') END ELSE o_orderstatus END AS status FROM orders")
def b1(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "NaN").otherwise(F.col("o_orderstatus"))).withColumn("other", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("<NA>"))
    return clean.coerce_text(o, "status", "other", prefix="row_", key="o_orderkey").select("o_orderkey", "status")


@query("b2_coerce_number", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN CASE WHEN event_id % 2 = 0 THEN round(value, 6) ELSE -1.0 END ELSE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k FROM events")
def b2(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").withColumn("k", F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.get_json_object("props", "$.k"))).withColumn("v", F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")))
    return r6(clean.coerce_number(e, "k", "v", -1.0).select("event_id", "k"), "k")


@query("b3_unit_keys", "SELECT coalesce(CASE WHEN c_nationkey % 5 <> 0 THEN c_mktsegment END, '<missing>') AS subject_id, '<missing>' AS day, c_nationkey::VARCHAR AS session, '<missing>' AS split_id, count(*) AS n FROM customer GROUP BY ALL")
def b3(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") % 5 != 0, F.col("c_mktsegment")).alias("subject_id"), F.col("c_nationkey").alias("session"))
    return clean.normalize_units(c).groupBy("subject_id", "day", "session", "split_id").agg(F.count(F.lit(1)).alias("n"))


@query("b4_infer_units", "SELECT unnest(['subject_id', 'session']) AS unit, (SELECT count(*) FROM customer) AS n")
def b4(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("subject_id"), F.col("c_nationkey").alias("session"))
    found = clean.infer_units(c)
    return c.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*map(F.lit, found))).alias("unit"), "n")


@query("b5_exclusions", "SELECT lang, count(*) AS kept, sum(doc_id)::BIGINT AS ids FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IN (SELECT doc_id FROM documents)) GROUP BY ALL")
def b5(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    bad = views.table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").join(d.select("doc_id"), "doc_id", "left_semi")
    kept, _ = clean.apply_exclusions(d, bad, "doc_id")
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("doc_id").alias("ids"))


@query("b6_label_index", sql.query(sql.M, body="SELECT row_id, label_raw, CAST(dense_rank() OVER (ORDER BY label_raw) - 1 AS INT) AS label FROM m"))
def b6(spark, sf_dir):
    return clean.index_labels(views.metadata(spark, sf_dir)).select("row_id", "label_raw", "label")


@query("b7_group_from_id", "SELECT c_custkey, CASE WHEN CAST(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT) >= 100 THEN 'amputee' ELSE 'able_bodied' END AS grp FROM customer")
def b7(spark, sf_dir):
    return views.table(spark, sf_dir, "customer").select("c_custkey", clean.group_from_id(F.col("c_name")).alias("grp"))


@query("b10_backfill_columns", sql.query(sql.U, body="SELECT unit, policy, round(metric, 6) AS metric, round(metric, 6) AS active_metric FROM un"))
def b10(spark, sf_dir):
    return r6(clean.backfill_columns(views.unit_metrics(spark, sf_dir), {"active_metric": "metric", "metric": "metric"}).select("unit", "policy", "metric", "active_metric"), "metric", "active_metric")


@query("b11_sampling_rate", sql.query(sql.X, "g AS (SELECT record_id, ts - lag(ts) OVER (PARTITION BY record_id ORDER BY t) AS gap FROM x WHERE t < 4096)", body="SELECT record_id, round(CASE WHEN count(*) < 3 OR count(CASE WHEN gap > 0 THEN 1 END) = 0 THEN 2000.0 ELSE 1e6 / median(CASE WHEN gap > 0 THEN gap END) END, 3) AS rate FROM g GROUP BY ALL"))
def b11(spark, sf_dir):
    s = clean.sampling_rate(views.samples(spark, sf_dir))
    return s.select("record_id", F.round(F.when(F.col("rate") == 2000.0, F.col("rate")).otherwise(F.col("rate") * 1e6), 3).alias("rate"))


# signals

RUNS = """rl AS (SELECT *, sum(ch) OVER (PARTITION BY record_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, coalesce((label <> lag(label) OVER (PARTITION BY record_id ORDER BY t))::INT, 0) AS ch FROM x)),
sg0 AS (SELECT record_id, run, any_value(label) AS label, min(t) AS start, max(t) + 1 AS "end", max(t) + 1 - min(t) AS length FROM rl GROUP BY record_id, run HAVING count(*) >= 2 AND any_value(label) <> 0),
sg AS (SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY start) - 1 AS segment, label, start, "end", length FROM sg0)"""


@query("c1_label_segments", sql.query(sql.X, RUNS, body="SELECT record_id, segment, label, start, \"end\", length FROM sg"))
def c1(spark, sf_dir):
    return sig.label_segments(views.samples(spark, sf_dir), 2, False)


@query("c2_prefix_windows", sql.query(sql.X, RUNS, "gr AS (SELECT unnest([1.5, 2.5, 3.0]) AS prefix_s, unnest([2, 2, 3]) AS prefix)", body="SELECT record_id, segment, label, prefix_s, start AS assist_start, start + prefix - 2 AS user_start, start + prefix AS stop FROM sg, gr WHERE prefix >= 2 AND prefix <= length"))
def c2(spark, sf_dir):
    s = sig.label_segments(views.samples(spark, sf_dir), 2, False)
    return sig.prefix_windows(s, [1.5, 2.5, 3.0], 1.0, 2.0)


WIN = "lm AS (SELECT record_id, max(t) AS last FROM x GROUP BY ALL), ww AS (SELECT x.*, w AS \"window\" FROM x JOIN lm USING (record_id), range(0, 100000, 5) r(w) WHERE w <= t AND t < w + 10 AND w + 10 <= last + 1)"


@query("c3_sliding_windows", sql.query(sql.X, WIN, body="SELECT record_id, \"window\", count(*) AS n, min(t) AS lo, max(t) AS hi FROM ww GROUP BY ALL"))
def c3(spark, sf_dir):
    return sig.sliding_windows(views.samples(spark, sf_dir), 10, 5).groupBy("record_id", "window").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))


def _windows(spark, sf_dir):
    return sig.sliding_windows(views.samples(spark, sf_dir), 10, 5)


TD = """dd AS (SELECT *, value - lag(value) OVER w AS d, coalesce(((value < 0) <> (lag(value) OVER w < 0))::INT, 0) AS s FROM ww WINDOW w AS (PARTITION BY record_id, "window" ORDER BY t)),
de AS (SELECT *, coalesce(((d < 0) <> (lag(d) OVER (PARTITION BY record_id, "window" ORDER BY t) < 0))::INT, 0) AS c FROM dd)"""


@query("c4_td_features", sql.query(sql.X, WIN, TD, body="SELECT record_id, \"window\", round(avg(abs(value)), 6) AS mav, round(sqrt(avg(value * value)), 6) AS rms, round(coalesce(sum(abs(d)), 0), 6) AS wl, CAST(sum(s) AS BIGINT) AS zc, CAST(sum(c) AS BIGINT) AS ssc FROM de GROUP BY ALL"))
def c4(spark, sf_dir):
    return r6(sig.td_features(_windows(spark, sf_dir)), "mav", "rms", "wl")


@query("c5_energy_thirds", sql.query(sql.X, WIN, "th AS (SELECT *, ntile(3) OVER (PARTITION BY record_id, \"window\" ORDER BY t) AS p FROM ww)", body="SELECT record_id, \"window\", " + ", ".join(f"round(coalesce(sqrt(avg(CASE WHEN p = {k} THEN value * value END)), 0), 6) AS third{k}" for k in (1, 2, 3)) + " FROM th GROUP BY ALL"))
def c5(spark, sf_dir):
    return r6(sig.energy_thirds(_windows(spark, sf_dir)), "third1", "third2", "third3")


@query("c6_masked_summary", sql.query(sql.X, WIN, body="SELECT record_id, \"window\", round(coalesce(avg(CASE WHEN NOT invalid THEN value END), 0), 6) AS mean, round(coalesce(stddev_pop(CASE WHEN NOT invalid THEN value END), 0), 6) AS std, round(1 - count(CASE WHEN NOT invalid THEN 1 END) / count(*), 6) AS missing FROM ww GROUP BY ALL"))
def c6(spark, sf_dir):
    return r6(sig.masked_summary(_windows(spark, sf_dir)), "mean", "std", "missing")


@query("c7_window_mode", sql.query(sql.X, WIN, "lc AS (SELECT record_id, \"window\", label, count(*) AS c FROM ww GROUP BY ALL)", body="SELECT record_id, \"window\", arg_max(label, {'c': c, 'l': -label}) AS label FROM lc GROUP BY ALL"))
def c7(spark, sf_dir):
    return sig.window_mode(_windows(spark, sf_dir))


@query("c8_availability", sql.query(sql.X, WIN, body="SELECT record_id, \"window\", bool_or(NOT invalid) AS available FROM ww GROUP BY ALL"))
def c8(spark, sf_dir):
    return sig.availability(_windows(spark, sf_dir))


@query("c10_compress_sequence", sql.query(sql.X, "nn AS (SELECT record_id, count(*) AS n, least(greatest(CAST(round_even(count(*) * 8.0 / 20.0, 0) AS BIGINT), 1), count(*)) AS k FROM x GROUP BY ALL), bb AS (SELECT record_id, n, k, b FROM nn, range(0, 4000) r(b) WHERE b < k)", body="SELECT bb.record_id, b AS bin, round(avg(value), 6) AS value FROM bb JOIN x ON x.record_id = bb.record_id AND t >= floor(b * n / k) AND t < floor((b + 1) * n / k) GROUP BY ALL"))
def c10(spark, sf_dir):
    return r6(sig.compress_sequence(views.samples(spark, sf_dir), 8, 20), "value")


@query("c11_pad_stack", sql.query(sql.V, body="SELECT vec_id, k, round(CASE WHEN vec_id % 2 = 0 THEN CASE WHEN k >= 6 THEN embedding[k - 5]::DOUBLE ELSE 0 END ELSE CASE WHEN k < 64 THEN embedding[k + 1]::DOUBLE ELSE 0 END END, 6) AS x FROM v, range(70) r(k)"))
def c11(spark, sf_dir):
    """Every cell: rows padded on the left, and on the right."""
    from heddle.functions.arrays import pad_left, pad_right

    p = F.when(F.col("vec_id") % 2 == 0, pad_left(F.col("features"), 70)).otherwise(pad_right(F.col("features"), 70))
    return views.features(spark, sf_dir).select("vec_id", F.posexplode(p).alias("k", "x")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("x", 6).alias("x"))


@query("c12_slice_mask", sql.query(sql.X, "gd AS (SELECT DISTINCT record_id, unnest(range(50, 60)) AS t FROM x)", body="SELECT gd.record_id, gd.t, round(coalesce(value, 0), 6) AS value, coalesce((NOT invalid)::INT, 0) AS valid FROM gd LEFT JOIN x USING (record_id, t)"))
def c12(spark, sf_dir):
    return r6(sig.slice_mask(views.samples(spark, sf_dir), 50, 60), "value")


C13 = ["mean", "std", "delta", "available", *[f"{n}{c}" for c in range(4) for n in ("mean", "available")]]
QUARTERS = ", ".join(f"round(sum(value * m) FILTER (WHERE t >= n * {c} // 4 AND t < n * {c + 1} // 4) / greatest(sum(m) FILTER (WHERE t >= n * {c} // 4 AND t < n * {c + 1} // 4), 1), 6) AS mean{c}, round(greatest(coalesce(sum(m) FILTER (WHERE t >= n * {c} // 4 AND t < n * {c + 1} // 4), 0), 1) / greatest(count(*) FILTER (WHERE t >= n * {c} // 4 AND t < n * {c + 1} // 4), 1), 6) AS available{c}" for c in range(4))


@query("c13_sequence_summary", sql.query(sql.X, "sn AS (SELECT *, (NOT invalid)::INT AS m, count(*) OVER (PARTITION BY record_id) AS n FROM x), sm AS (SELECT record_id, sum(value * m) / greatest(sum(m), 1) AS mu FROM sn GROUP BY ALL)", body=f"SELECT record_id, round(any_value(mu), 6) AS mean, round(sqrt(sum(((value - mu) * m) ** 2) / greatest(sum(m), 1)), 6) AS std, round(greatest(sum(m), 1) / count(*), 6) AS available, round(coalesce(arg_max(value, t) FILTER (WHERE m = 1), any_value(value) FILTER (WHERE t = 0)) - coalesce(arg_min(value, t) FILTER (WHERE m = 1), any_value(value) FILTER (WHERE t = 0)), 6) AS delta, {QUARTERS} FROM sn JOIN sm USING (record_id) GROUP BY record_id HAVING count(*) >= 4"))
def c13(spark, sf_dir):
    s = views.samples(spark, sf_dir)
    long = s.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 4").select("record_id")
    return r6(sig.sequence_summary(s.join(long, "record_id", "left_semi")).select("record_id", *C13), *C13)


LONG = "lg AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM v)"


@query("c14_robust_z", sql.query(sql.V, LONG, "md AS (SELECT i, median(x) AS med FROM lg GROUP BY ALL), ma AS (SELECT lg.i, any_value(med) AS med, median(abs(x - med)) AS mad FROM lg JOIN md USING (i) GROUP BY ALL)", body="SELECT vec_id, round(sum((x - med) / (1.4826 * mad + 1e-8)), 5) AS total FROM lg JOIN ma USING (i) GROUP BY ALL"))
def c14(spark, sf_dir):
    z = sig.robust_z(views.features(spark, sf_dir), "vec_id")
    return z.select("vec_id", F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("c15_standardize", sql.query(sql.V, LONG, "sd AS (SELECT i, avg(x) AS mu, stddev_pop(x) AS sd FROM lg GROUP BY ALL)", body="SELECT vec_id, round(sum((x - mu) / CASE WHEN sd < 1e-6 THEN 1 ELSE sd END), 5) AS total FROM lg JOIN sd USING (i) GROUP BY ALL"))
def c15(spark, sf_dir):
    f = views.features(spark, sf_dir)
    return sig.standardize(f, f, "vec_id").select("vec_id", F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("c16_channel_dropout", sql.query(sql.V, body="SELECT count(*) AS n, true AS near, true AS kept FROM v"))
def c16(spark, sf_dir):
    """near: whether the share of zeroed features is within a fiftieth of the rate; kept: whether the others are unchanged."""
    f = views.features(spark, sf_dir).withColumn("own", F.col("features"))
    d = sig.channel_dropout(f, "vec_id", 0.1, 7)
    same = F.forall(F.zip_with("features", "own", lambda x, y: (x == 0) | (x == y)), lambda ok: ok)
    zeroed = F.size(F.filter(F.zip_with("features", "own", lambda x, y: (x == 0) & (y != 0)), lambda z: z))
    return d.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.sum(zeroed) / F.sum(F.size("features")) - 0.1) < 0.02).alias("near"), F.bool_and(same).alias("kept"))


@query("c17_fir_filter", sql.query(sql.X, "fl AS (SELECT record_id, t, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM x WINDOW w AS (PARTITION BY record_id ORDER BY t))", body="SELECT record_id, t, round((coalesce(a * 0.25, 0) + value * 0.5 + coalesce(b * 0.25, 0)) / (0.5 + CASE WHEN a IS NULL THEN 0 ELSE 0.25 END + CASE WHEN b IS NULL THEN 0 ELSE 0.25 END), 6) AS value FROM fl"))
def c17(spark, sf_dir):
    return r6(sig.fir_filter(views.samples(spark, sf_dir), [0.25, 0.5, 0.25]).select("record_id", "t", "value"), "value")


# splits

#: n and a fingerprint of each side's members, from pairs of rows and splits
ROLES = "SELECT split_id, role, count(*) AS n, sum(row_id)::BIGINT AS ids, sum(row_id * row_id % 1000003)::BIGINT AS squares FROM s GROUP BY ALL"


def _sides(family):
    row = F.col("row_id").cast("long")
    return family.totals({"ids": row, "squares": row * row % 1_000_003})


def _counts(members):
    row = F.col("row_id").cast("long")
    return members.groupBy("split_id", "role").agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("ids"), F.sum(row * row % 1_000_003).alias("squares"))


@query("d1_leave_one_group_out", sql.query(sql.M, "s AS (SELECT 'logo|' || g AS split_id, row_id, CASE WHEN m.\"group\" = g THEN 'test' ELSE 'train' END AS role FROM m, (SELECT DISTINCT \"group\" AS g FROM m))", body=ROLES))
def d1(spark, sf_dir):
    return _sides(splits.logo_family(views.metadata(spark, sf_dir), "group"))


@query("d1_members", sql.query(sql.M, "s AS (SELECT 'logo|' || g AS split_id, row_id, CASE WHEN m.\"group\" = g THEN 'test' ELSE 'train' END AS role FROM m, (SELECT DISTINCT \"group\" AS g FROM m) WHERE g IN ('BUILDING', 'MACHINERY'))", body="SELECT split_id, row_id, role FROM s"))
def d1_members(spark, sf_dir):
    """Members of two of the splits, read by their ids."""
    return splits.logo_family(views.metadata(spark, sf_dir), "group").members(["logo|BUILDING", "logo|MACHINERY"])


GREEDY = """gc AS (SELECT g, c, row_number() OVER (ORDER BY c DESC, g) AS k FROM (SELECT coalesce(CASE WHEN subject_id <> 7 THEN subject_id::VARCHAR END, '<missing>') AS g, count(*) AS c FROM m GROUP BY ALL)),
gl AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0]::BIGINT[] AS load, NULL::VARCHAR AS g, NULL::BIGINT AS fold
  UNION ALL SELECT gc.k, list_transform(gl.load, lambda x, i: x + CASE WHEN i = list_position(gl.load, list_min(gl.load)) THEN gc.c ELSE 0 END), gc.g, (list_position(gl.load, list_min(gl.load)) - 1)::BIGINT FROM gl JOIN gc ON gc.k = gl.k + 1),
s AS (SELECT 'fold|' || f AS split_id, row_id, CASE WHEN fold = f THEN 'test' ELSE 'train' END AS role FROM m JOIN gl ON gl.g = coalesce(CASE WHEN subject_id <> 7 THEN subject_id::VARCHAR END, '<missing>'), range(4) q(f))"""


@query("d2_group_k_fold", "WITH RECURSIVE " + sql.query(sql.M, GREEDY, body=ROLES).removeprefix("WITH "))
def d2(spark, sf_dir):
    """One subject is without a name, which is a group too."""
    m = views.metadata(spark, sf_dir).withColumn("subject_id", F.when(F.col("subject_id") != 7, F.col("subject_id")))
    return _sides(splits.kfold_family(m, "subject_id", 4))


@query("d3_heldout_with_background", sql.query(sql.M, "s AS (SELECT 'heldout|' || g AS split_id, row_id, CASE WHEN subject_id::VARCHAR = g THEN 'test' ELSE 'train' END AS role FROM m, (SELECT DISTINCT subject_id::VARCHAR AS g FROM m WHERE \"group\" = 'BUILDING'))", body=ROLES))
def d3(spark, sf_dir):
    return _sides(splits.heldout_family(views.metadata(spark, sf_dir), "group", "BUILDING"))


@query("d4_forward_chain", sql.query(sql.M, "p AS (SELECT DISTINCT day, CAST(substr(day, 4) AS INT) AS r FROM m), s AS (SELECT 'forward_day|' || p.day AS split_id, row_id, CASE WHEN CAST(substr(m.day, 4) AS INT) = r THEN 'test' ELSE 'train' END AS role FROM m, p WHERE CAST(substr(m.day, 4) AS INT) <= r AND r > (SELECT min(r) FROM p))", body=ROLES))
def d4(spark, sf_dir):
    return _sides(splits.forward_family(views.metadata(spark, sf_dir), "day", numeric=True, prefix="forward_day"))


@query("d5_population_regimes", sql.query(sql.T, """g AS (SELECT DISTINCT subject_id AS g FROM t0 WHERE "group" = 'target'), r AS (SELECT unnest(['background_to_target', 'mixed_to_target', 'target_loso']) AS regime),
s AS (SELECT regime || '|' || g AS split_id, event_id AS row_id, CASE WHEN subject_id = g THEN 'test' ELSE 'train' END AS role FROM t0, g, r WHERE subject_id = g OR regime = 'mixed_to_target' OR (regime = 'background_to_target' AND "group" <> 'target') OR (regime = 'target_loso' AND "group" = 'target'))""", body=ROLES))
def d5(spark, sf_dir):
    return _sides(splits.population_family(views.base_traces(spark, sf_dir).withColumnRenamed("event_id", "row_id")))


CAL = """s AS (SELECT 'logo|' || g AS split_id, event_id AS row_id, subject_id, CASE WHEN subject_id = g THEN 'test' ELSE 'train' END AS role FROM t0, (SELECT DISTINCT subject_id AS g FROM t0)),
su AS (SELECT split_id, subject_id, row_number() OVER (PARTITION BY split_id ORDER BY subject_id DESC) AS k, count(*) OVER (PARTITION BY split_id) AS n FROM (SELECT DISTINCT split_id, subject_id FROM s WHERE role = 'train')),
c AS (SELECT s.split_id, row_id, CASE WHEN role = 'train' AND k <= greatest(1, n // 5) THEN 'cal' ELSE role END AS role FROM s LEFT JOIN su ON su.split_id = s.split_id AND su.subject_id = s.subject_id)"""


@query("d6_calibration_holdout", sql.query(sql.T, CAL, body=ROLES.replace("FROM s ", "FROM c ")))
def d6(spark, sf_dir):
    t = views.base_traces(spark, sf_dir).withColumnRenamed("event_id", "row_id")
    return _counts(splits.calibration_holdout(splits.leave_one_group_out(t, "subject_id"), t))


@query("d7_leakage_check", sql.query(sql.M, body="SELECT 'logo|' || g AS split_id, count(DISTINCT subject_id) AS leaks FROM (SELECT DISTINCT \"group\" AS g FROM m), m WHERE subject_id IN (SELECT subject_id FROM m m2 WHERE m2.\"group\" = g) AND subject_id IN (SELECT subject_id FROM m m3 WHERE m3.\"group\" <> g) GROUP BY ALL"))
def d7(spark, sf_dir):
    m = views.metadata(spark, sf_dir)
    return splits.family_leakage(splits.logo_family(m, "group"), m, ["subject_id"]).groupBy("split_id").agg(F.count(F.lit(1)).alias("leaks"))


@query("d8_split_filters", sql.query(sql.T, "f AS (SELECT split_id, split_part(split_id, '|', 1) AS split_family, row_number() OVER (PARTITION BY split_part(split_id, '|', 1) ORDER BY split_id) AS k FROM (SELECT DISTINCT split_id FROM t))", body="SELECT split_id, split_family FROM f WHERE split_family IN ('logo', 'forward_day') AND k <= 3"))
def d8(spark, sf_dir):
    return splits.filter_splits(views.traces(spark, sf_dir).select("split_id").distinct(), ["logo", "forward_day"], per_family=3)


@query("d8_split_ids", sql.query(sql.T, body="SELECT DISTINCT split_id, split_part(split_id, '|', 1) AS split_family FROM t WHERE split_id IN ('logo|S01', 'logo|S07', 'forward_day|D03')"))
def d8_ids(spark, sf_dir):
    return splits.filter_splits(views.traces(spark, sf_dir).select("split_id").distinct(), ids=["logo|S01", "logo|S07", "forward_day|D03", "logo|none"])


@query("d9_repetition_holdout", sql.query(sql.M, "k AS (SELECT *, session % 4 AS repetition FROM m WHERE \"group\" <> 'BUILDING'), s AS (SELECT 'loro|' || g AS split_id, row_id, CASE WHEN repetition = g THEN 'test' ELSE 'train' END AS role FROM k, (SELECT DISTINCT repetition AS g FROM k))", body=ROLES))
def d9(spark, sf_dir):
    return _sides(splits.repetition_family(views.metadata(spark, sf_dir).withColumn("repetition", F.col("session") % 4), F.col("group") != "BUILDING"))


@query("d10_quota_folds", sql.query(sql.M, "e AS (SELECT row_id // 3 AS episode_id, row_id, subject_id, CAST(dense_rank() OVER (ORDER BY label_raw) - 1 AS INT) AS label, session % 2 AS dynamic, row_id % 4 % 3 AS position FROM m), f AS (SELECT * FROM e WHERE label <> 0 QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY row_id) = 1), q AS (SELECT *, CASE WHEN dynamic = 1 THEN 2 WHEN position IN (0, 1) THEN 3 ELSE 0 END AS quota, row_number() OVER (PARTITION BY subject_id, label, dynamic, position ORDER BY episode_id, row_id) - 1 AS r FROM f)", body="SELECT subject_id, label, dynamic, position, episode_id, r % 4 AS fold FROM q WHERE r < quota * 4"))
def d10(spark, sf_dir):
    """Three rows to an episode; sessions of odd years are dynamic."""
    m = clean.index_labels(views.metadata(spark, sf_dir)).withColumns({"episode_id": F.floor(F.col("row_id") / 3), "dynamic": F.col("session") % 2, "position": F.col("row_id") % 4 % 3})
    f = splits.quota_folds(m, ["subject_id", "label", "dynamic", "position"], splits.episode_quota(F.col("dynamic"), F.col("position")))
    return f.withColumns({"dynamic": F.col("dynamic").cast("long"), "fold": F.col("fold").cast("long")})


@query("d11_split_dispatch", sql.query(sql.M, "p AS (SELECT DISTINCT session AS r FROM m), s AS (SELECT 'dayshift|' || r AS split_id, row_id, CASE WHEN session = r THEN 'test' ELSE 'train' END AS role FROM m, p WHERE session <= r AND r > (SELECT min(r) FROM p) UNION ALL SELECT 'subject_logo|' || g, row_id, CASE WHEN subject_id = g THEN 'test' ELSE 'train' END FROM m, (SELECT DISTINCT subject_id AS g FROM m))", body=ROLES))
def d11(spark, sf_dir):
    first, second = (_sides(f) for f in splits.families_for(views.metadata(spark, sf_dir), "sessions"))
    return first.unionByName(second)


@query("d11_split_kinds", sql.query(sql.T, "p AS (SELECT DISTINCT day AS d FROM t0), g AS (SELECT DISTINCT subject_id AS g FROM t0 WHERE \"group\" = 'target'), s AS (SELECT 'forward_day|' || d AS split_id, event_id AS row_id, CASE WHEN day = d THEN 'test' ELSE 'train' END AS role FROM t0, p WHERE day <= d AND d > (SELECT min(d) FROM p) UNION ALL SELECT 'mixed_to_target|' || g, event_id, CASE WHEN subject_id = g THEN 'test' ELSE 'train' END FROM t0, g UNION ALL SELECT 'background_to_target|' || g, event_id, CASE WHEN subject_id = g THEN 'test' ELSE 'train' END FROM t0, g WHERE subject_id = g OR \"group\" <> 'target' UNION ALL SELECT 'target_loso|' || g, event_id, CASE WHEN subject_id = g THEN 'test' ELSE 'train' END FROM t0, g WHERE \"group\" = 'target')", body=ROLES))
def d11b(spark, sf_dir):
    """The two other kinds of dataset."""
    t = views.base_traces(spark, sf_dir).withColumnRenamed("event_id", "row_id")
    days, people = (_sides(splits.families_for(t, kind)[0]) for kind in ("days", "population"))
    return days.unionByName(people)


@query("d12_dev_holdout", "SELECT role, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(['dev', 'train']) AS role, unnest([floor(c * 0.2), c - floor(c * 0.2)]) AS n FROM (SELECT label, count(*) AS c FROM embeddings GROUP BY ALL)) GROUP BY role")
def d12(spark, sf_dir):
    f = views.features(spark, sf_dir).withColumnRenamed("vec_id", "row_id")
    return splits.dev_holdout(f, 0.2, 7).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def _fit(spec: str):
    def run(spark, sf_dir):
        f = views.features(spark, sf_dir).withColumnRenamed("vec_id", "row_id").withColumn("fold", F.col("row_id") % 3)
        scored = scoring.fit_score(f, splits.leave_one_group_out(f, "fold"), spec, 10)
        return scored.select("split_id", "row_id", "role", F.transform("p", lambda x: F.round(x, 6)).alias("p"))

    return run


for _spec in ("logistic", "forest", "mlp", "lda"):
    query(f"e1_{_spec}")(_fit(_spec))


# inference

PAIR = "pm AS (SELECT unit, avg(CASE WHEN policy = 'A' THEN metric END) AS a, avg(CASE WHEN policy = 'N' THEN metric END) AS b FROM un GROUP BY ALL)"


def _pairs(spark, sf_dir):
    return inference.paired_matrix(views.unit_metrics(spark, sf_dir), ["unit"], "A", "N", "metric")


@query("j1_paired_matrix", sql.query(sql.U, PAIR, body="SELECT unit, round(a, 6) AS a, round(b, 6) AS b, round(a - b, 6) AS delta FROM pm"))
def j1(spark, sf_dir):
    return r6(_pairs(spark, sf_dir), "a", "b", "delta")


def _inside(df, *names: str):
    """The drawn interval as two marks: whether it holds the estimate, and whether its half width is within a fifth of 1.96 standard errors."""
    half = (F.col("ci_high") - F.col("ci_low")) / 2
    marks = {"inside": (F.col("ci_low") <= F.col("estimate")) & (F.col("estimate") <= F.col("ci_high"))}
    if "error" in df.columns:
        marks["near"] = F.abs(half - 1.96 * F.col("error")) <= 0.2 * 1.96 * F.col("error")
    return r6(df.withColumns(marks).select(*names, "estimate", *marks), "estimate")


@query("j2_bootstrap_ci", sql.query(sql.U, PAIR, body="SELECT round(avg(a - b), 6) AS estimate, count(*) AS n, true AS inside, true AS near FROM pm"))
def j2(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).withColumn("g", F.lit(1))
    error = pairs.agg((F.stddev_pop("delta") / F.sqrt(F.count("delta"))).alias("error")).withColumn("g", F.lit(1))
    return _inside(inference.bootstrap_ci(pairs, "delta", ["g"]).join(error, "g"), "n")


@query("j3_nested_bootstrap_ci", sql.query(sql.U, body="SELECT policy, round(avg(metric), 6) AS estimate, true AS inside FROM un GROUP BY ALL"))
def j3(spark, sf_dir):
    u = views.unit_metrics(spark, sf_dir).withColumn("block", F.col("unit") % 5)
    return _inside(inference.nested_bootstrap_ci(u, "metric", ["block", "unit", "absent"], ["policy"]), "policy")


@query("j4_signflip_p", sql.query(sql.U, PAIR, body="SELECT count(*) AS n, true AS inside, abs(avg(a - b)) > 4 * sqrt(avg((a - b) ** 2) / count(*)) AS far FROM pm"))
def j4(spark, sf_dir):
    """far: whether the p value says what a mean beyond four standard errors must give."""
    p = inference.signflip_p(_pairs(spark, sf_dir).withColumn("g", F.lit(1)), "delta", ["g"])
    return p.select("n", F.col("p_value").between(0, 1).alias("inside"), (F.col("p_value") <= 1 / 2001 + 1e-12).alias("far"))


SMALL = "sm AS (SELECT unit // 8 AS g, unit, a - b AS v FROM pm), nb AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY g) AS n FROM sm), fl AS (SELECT g, r, avg(CASE WHEN (r >> k) & 1 = 1 THEN v ELSE -v END) AS mm FROM nb, range(256) q(r) WHERE r < (1 << n) GROUP BY ALL), ob AS (SELECT g, avg(v) AS o FROM sm GROUP BY ALL)"


@query("j4_exact_signflip_p", sql.query(sql.U, PAIR, SMALL, body="SELECT g, round(avg((abs(mm) >= abs(o) - 1e-12)::INT), 6) AS p_value, count(*) <= 4096 AS exact FROM fl JOIN ob USING (g) GROUP BY ALL"))
def j4b(spark, sf_dir):
    d = _pairs(spark, sf_dir).withColumn("g", F.floor(F.col("unit") / 8))
    return r6(inference.exact_signflip_p(d, "delta", ["g"]), "p_value")


@query("j5_paired_test", sql.query(sql.U, PAIR, body="SELECT round(avg(a - b), 6) AS estimate, count(*) AS n FROM pm"))
def j5(spark, sf_dir):
    return r6(inference.paired_test(views.unit_metrics(spark, sf_dir), ["unit"], "A", "N", "metric").select("estimate", "n"), "estimate")


HOLM = """pv AS (SELECT unit, policy, unit % 7 AS fam, round(n / 5000.0, 6) AS p FROM un),
rk AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY p, unit, policy) AS holm_rank, count(*) OVER (PARTITION BY fam) AS n_tests FROM pv),
hr AS (SELECT *, 0.05 / (n_tests - holm_rank + 1) AS holm_threshold FROM rk)"""


@query("j6_j7_holm", sql.query(sql.U, HOLM, body="SELECT unit, policy, fam, holm_rank, n_tests, round(holm_threshold, 6) AS holm_threshold, min((p <= holm_threshold)::INT) OVER (PARTITION BY fam ORDER BY p, unit, policy ROWS UNBOUNDED PRECEDING) = 1 AS holm_reject FROM hr"))
def j6(spark, sf_dir):
    u = views.unit_metrics(spark, sf_dir).select("unit", "policy", (F.col("unit") % 7).alias("fam"), F.round(F.col("n") / 5000.0, 6).alias("p"))
    return r6(inference.holm_annotate(u, ["fam"], "p", ["unit", "policy"]).drop("p"), "holm_threshold")


@query("j8_pairwise_table", sql.query(sql.U, "lo AS (SELECT unit, policy, unnest(['metric', 'budget']) AS metric, unnest([metric, budget]) AS value FROM un), pr AS (SELECT a.metric, a.value - b.value AS d FROM lo a JOIN lo b USING (unit, metric) WHERE a.policy = 'A' AND b.policy = 'N')", body="SELECT 'all' AS split_family, metric, round(avg(d), 6) AS estimate, count(*) AS n, CASE WHEN metric = 'budget' THEN avg(d) < 0 ELSE avg(d) > 0 END AS beneficial FROM pr GROUP BY metric"))
def j8(spark, sf_dir):
    u = views.unit_metrics(spark, sf_dir).withColumn("split_family", F.lit("all"))
    pairs = u.where("policy = 'A'").select(F.col("policy").alias("policy_a"), F.lit("N").alias("policy_b")).distinct()
    t = inference.pairwise_table(u, ["unit"], pairs, ["metric", "budget"], ("budget",))
    return r6(t.select("split_family", "metric", "estimate", "n", "beneficial"), "estimate")


#: the seven metrics of policy intervals, as columns of lineitem
SEVEN = {"accuracy": "l_discount", "macro_f1": "l_tax", "active_macro_f1": "l_quantity", "risk_coverage_auc": "l_extendedprice / 100000", "active_risk_coverage_auc": "l_discount * l_tax", "mean_ali": "l_linenumber", "intervention_rate": "l_discount - l_tax"}


@query("j9_policy_ci", "SELECT 'all' AS split_family, l_returnflag AS policy, metric, round(avg(value), 6) AS estimate, true AS inside FROM (" + " UNION ALL ".join(f"SELECT l_returnflag, l_suppkey, '{m}' AS metric, avg({x}) AS value FROM lineitem GROUP BY ALL" for m, x in SEVEN.items()) + ") GROUP BY ALL")
def j9(spark, sf_dir):
    u = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("subject_id"), F.col("l_returnflag").alias("policy")).agg(*[F.avg(F.expr(x)).alias(m) for m, x in SEVEN.items()])
    u = u.withColumn("split_family", F.lit("all")).withColumn("split_id", F.concat(F.lit("all|"), (F.col("subject_id") % 5).cast("string"))).withColumn("day", F.lit(None).cast("string"))
    return _inside(inference.policy_ci(u, list(SEVEN), ["split_id", "subject_id", "session", "day"]), "split_family", "policy", "metric")


@query("j10_report_pairwise", sql.query(sql.U, "lo AS (SELECT unit, policy, unnest(['metric', 'budget']) AS metric, unnest([metric, budget]) AS value FROM un), pr AS (SELECT a.policy, a.metric, a.value - b.value AS d FROM lo a JOIN lo b USING (unit, metric) WHERE a.policy <> 'N' AND b.policy = 'N')", body="SELECT 'all' AS split_family, metric, policy AS policy_a, 'N' AS policy_b, round(avg(d), 6) AS estimate, count(*) AS n, 2 AS n_tests, any_value(CASE WHEN metric = 'budget' THEN -1 ELSE 1 END) * avg(d) > 0 AS beneficial, true AS inside FROM pr GROUP BY ALL"))
def j10(spark, sf_dir):
    u = views.unit_metrics(spark, sf_dir).withColumn("split_family", F.lit("all"))
    pairs = u.where("policy <> 'N'").select(F.col("policy").alias("policy_a"), F.lit("N").alias("policy_b")).distinct()
    t = inference.report_pairwise(u, ["unit"], pairs, ["metric", "budget"], ("budget",))
    marks = (F.col("ci_low") <= F.col("estimate")) & (F.col("estimate") <= F.col("ci_high")) & F.col("p_value").between(0, 1) & (F.col("beneficial_and_holm_significant") == (F.col("beneficial") & F.col("holm_reject")))
    return r6(t.select("split_family", "metric", "policy_a", "policy_b", "estimate", "n", F.col("n_tests").cast("int").alias("n_tests"), "beneficial", marks.alias("inside")), "estimate")


@query("j11_significance_flag", sql.query(sql.U, HOLM, body="SELECT unit, policy, p < 0.01 AND min((p <= holm_threshold)::INT) OVER (PARTITION BY fam ORDER BY p, unit, policy ROWS UNBOUNDED PRECEDING) = 1 AS flagged FROM hr"))
def j11(spark, sf_dir):
    u = views.unit_metrics(spark, sf_dir).select("unit", "policy", (F.col("unit") % 7).alias("fam"), F.round(F.col("n") / 5000.0, 6).alias("p"))
    return inference.holm_annotate(u, ["fam"], "p", ["unit", "policy"]).select("unit", "policy", ((F.col("p") < 0.01) & F.col("holm_reject")).alias("flagged"))


# sources


@query("a2_prepared_io", sql.query(sql.M, body="SELECT subject_id, count(*) AS rows, sum(row_id)::BIGINT AS ids, round(sum(value), 2) AS value, count(DISTINCT day) AS days FROM m GROUP BY ALL"))
def a2(spark, sf_dir):
    """Written, checked by its number of rows, and read back."""
    path = store.scratch(spark, "prepared")
    files.write_prepared(views.metadata(spark, sf_dir), path)
    back = files.read_prepared(spark, path).groupBy("subject_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("row_id").alias("ids"), F.round(F.sum("value"), 2).alias("value"), F.count_distinct("day").alias("days"))
    return store.small_result(back, path, path + ".rows")


@query("a4_path_manifest", "SELECT DISTINCT url, regexp_extract(url, '://([^/]+)/([a-z]{2})/([0-9]+)', 1) AS host, regexp_extract(url, '://([^/]+)/([a-z]{2})/([0-9]+)', 2) AS lang, regexp_extract(url, '://([^/]+)/([a-z]{2})/([0-9]+)', 3) AS number FROM pages WHERE regexp_matches(url, '://([^/]+)/([a-z]{2})/([0-9]+)')")
def a4(spark, sf_dir):
    return files.path_manifest(views.table(spark, sf_dir, "pages"), "url", "://([^/]+)/([a-z]{2})/([0-9]+)", ["host", "lang", "number"])


@query("a5_sidecar_labels", "SELECT conv_id, turn, role AS label_raw FROM conversations")
def a5(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    order = F.array_sort(F.collect_list(F.struct("turn", "role")))
    side = c.groupBy("conv_id").agg(F.array_join(F.transform(order, lambda x: x["role"]), ",\n").alias("text"))
    from pyspark.sql import Window

    rows = c.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role")))
    return files.attach_sidecar(rows, side, "conv_id", "k", "text").select("conv_id", "turn", "label_raw")


@query("a9_missing_files", "SELECT o_orderkey, suffix FROM (SELECT DISTINCT o_orderkey FROM orders), (SELECT unnest(['O', 'F', 'X']) AS suffix) WHERE (o_orderkey, suffix) NOT IN (SELECT l_orderkey, l_linestatus FROM lineitem)")
def a9(spark, sf_dir):
    present = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("suffix"))
    return files.missing_files(views.table(spark, sf_dir, "orders"), present, ["o_orderkey"], ["O", "F", "X"])


#: what is left of orders at each of two runs, and how a year's rows changed in between
AGAIN = """o1 AS (SELECT year(o_orderdate)::VARCHAR AS part, o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) < 1998),
o2 AS (SELECT year(o_orderdate)::VARCHAR AS part, o_orderkey, CASE WHEN year(o_orderdate) = 1995 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE year(o_orderdate) > 1992),
pr AS (SELECT part, CASE WHEN b.part IS NULL THEN 'removed' WHEN a.part IS NULL THEN 'new' WHEN a.s <> b.s THEN 'changed' ELSE 'fresh' END AS status, coalesce(b.n, 0) AS rows
  FROM (SELECT part, sum(o_totalprice) AS s, count(*) AS n FROM o1 GROUP BY ALL) a FULL JOIN (SELECT part, sum(o_totalprice) AS s, count(*) AS n FROM o2 GROUP BY ALL) b USING (part))"""


def _two_runs(spark, sf_dir, root: str):
    """The progress of the second of two runs over orders by year: one year left, one came, one changed."""
    year = F.year("o_orderdate")
    o = views.table(spark, sf_dir, "orders").withColumn("part", year.cast("string"))
    runs = (o.where(year < 1998), o.where(year > 1992).withColumn("o_totalprice", F.when(year == 1995, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))))
    for now in runs:
        prints = files.part_fingerprints(now, "part", ["o_orderkey", "o_totalprice"])
        progress = parts.refresh_parts(spark, root, prints, lambda stale, now=now: now.join(stale, "part", "left_semi").select("part", "o_orderkey", "o_totalprice"))
    return progress


@query("a10_incremental_parts", sql.query(AGAIN, body="SELECT part, status, rows FROM pr"))
def a10(spark, sf_dir):
    root = store.scratch(spark, "parts")
    return store.small_result(_two_runs(spark, sf_dir, root).select("part", "status", "rows"), root)


@query("a10_merged_parts", sql.query(AGAIN, body="SELECT part, count(*) AS rows, sum(o_orderkey)::BIGINT AS keys, round(sum(o_totalprice), 2) AS price FROM o2 GROUP BY ALL"))
def a10b(spark, sf_dir):
    """The table after both runs, read through its current version."""
    root = store.scratch(spark, "parts")
    _two_runs(spark, sf_dir, root)
    merged = parts.read_parts(spark, root).groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("price"))
    return store.small_result(merged, root)


@query("a11_merge_prepared", sql.query(sql.M, body="SELECT label_raw, CAST(dense_rank() OVER (ORDER BY label_raw) - 1 AS INT) AS label, count(*) AS n FROM m GROUP BY label_raw"))
def a11(spark, sf_dir):
    m = views.metadata(spark, sf_dir).withColumns({"f": F.array("value", "value"), "seq": F.create_map(F.lit("emg"), F.array("value"))})
    merged = clean.index_labels(files.merge_prepared([m.where("row_id % 2 = 0"), m.where("row_id % 2 = 1")], "f", "seq"))
    return merged.groupBy("label_raw", "label").agg(F.count(F.lit(1)).alias("n"))


@query("a12_prepared_summary", sql.query(sql.M, body="SELECT count(*) AS rows, count(DISTINCT label_raw) AS vocabulary, count(DISTINCT subject_id) AS subjects, count(DISTINCT session) AS sessions, count(DISTINCT day) AS days, 3 AS width, 'acc|emg' AS sequence_keys FROM m"))
def a12(spark, sf_dir):
    m = views.metadata(spark, sf_dir).withColumns({"f": F.array("value", "value", "value"), "seq": F.create_map(F.lit("emg"), F.array("value"), F.lit("acc"), F.array("value"))})
    return files.prepared_summary(m, "f", "seq")


@query("a13_forbidden_scan", "SELECT doc_id, literal FROM documents, (SELECT unnest(['###', 'License', '@']) AS literal) WHERE contains(text, literal)")
def a13(spark, sf_dir):
    literals = spark.range(1).select(F.explode(F.array(*map(F.lit, ("###", "License", "@", "")))).alias("literal"))
    return files.forbidden_scan(views.table(spark, sf_dir, "documents"), "doc_id", "text", literals)


# gates over comparison rows derived from lineitem

CMP = """cmp AS (SELECT 'd' || (l_suppkey % 2) AS dataset_id, 'f' || (l_linenumber % 3) AS split_family, CASE WHEN l_returnflag = 'A' THEN 'active_macro_f1' ELSE 'active_risk_coverage_auc' END AS metric, format('{:.2f}', 0.05 * (1 + l_partkey % 4)) AS tau, avg(l_discount - l_tax) AS estimate, avg(l_tax) AS gap, avg(l_discount) AS mt FROM lineitem GROUP BY ALL),
cf AS (SELECT *, CASE WHEN metric = 'active_macro_f1' THEN estimate > 0 ELSE estimate < 0 END AS beneficial, abs(estimate) > 0.0098 AS holm_reject FROM cmp)"""


def _comparisons(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    g = li.groupBy(F.concat(F.lit("d"), (F.col("l_suppkey") % 2).cast("string")).alias("dataset_id"), F.concat(F.lit("f"), (F.col("l_linenumber") % 3).cast("string")).alias("split_family"), F.when(F.col("l_returnflag") == "A", "active_macro_f1").otherwise("active_risk_coverage_auc").alias("metric"), F.format_string("%.2f", F.lit(0.05) * (1 + F.col("l_partkey") % 4)).alias("tau"))
    c = g.agg(F.avg(F.col("l_discount") - F.col("l_tax")).alias("estimate"), F.avg("l_tax").alias("mean_abs_intervention_rate_gap"), F.avg("l_discount").alias("exact_match_fraction"))
    c = c.withColumn("beneficial", inference.beneficial(F.col("metric"), F.col("estimate"), ("active_risk_coverage_auc",))).withColumn("holm_reject", F.abs("estimate") > 0.0098)
    return c.withColumn("beneficial_and_holm_significant", F.col("beneficial") & F.col("holm_reject"))


@query("k5_best_tau", sql.query(CMP, body="SELECT dataset_id, split_family, metric, arg_max(tau, {'s': CASE WHEN metric = 'active_risk_coverage_auc' THEN -estimate ELSE estimate END, 't': -CAST(tau AS DOUBLE)}) AS best_tau FROM cf GROUP BY ALL"))
def k5(spark, sf_dir):
    return reports.best_tau(_comparisons(spark, sf_dir))


BOTH = """c2 AS (SELECT * REPLACE (CASE WHEN metric = 'active_macro_f1' THEN estimate ELSE -estimate END AS estimate) FROM cmp),
c3 AS (SELECT *, CASE WHEN metric = 'active_macro_f1' THEN estimate > 0 ELSE estimate < 0 END AS good, abs(estimate) > 0.0098 AS rejected FROM c2),
bt AS (SELECT dataset_id, split_family, tau, count(DISTINCT CASE WHEN good AND rejected THEN metric END) AS k, count(*) FILTER (WHERE rejected AND NOT good) AS harmful, count(*) AS n, avg(gap) AS gap, avg(mt) AS mt FROM c3 GROUP BY ALL)"""


@query("k3_instability_by_tau", sql.query(CMP, BOTH, body="SELECT dataset_id, split_family, tau, n AS primary_count, k AS primary_significant, harmful AS primary_harmful, round(gap, 6) AS confidence_gap, round(mt, 6) AS confidence_match, n AS safety_count, k AS safety_significant, harmful AS safety_harmful, round(gap, 6) AS earliest_gap, round(mt, 6) AS earliest_match, k = 2 AS all_primary_significant, CASE WHEN split_family = 'f0' THEN 'descriptive' ELSE 'required' END AS scope FROM bt"))
def k3(spark, sf_dir):
    _, t = _both_sides(spark, sf_dir, ["f1", "f2"])
    return r6(t, "confidence_gap", "confidence_match", "earliest_gap", "earliest_match")


@query("k1_candidate_eval", sql.query(CMP, body="SELECT tau, count(DISTINCT CASE WHEN metric = 'active_macro_f1' AND beneficial AND holm_reject THEN split_family END) AS active_macro_f1, count(DISTINCT CASE WHEN metric = 'active_risk_coverage_auc' AND beneficial AND holm_reject THEN split_family END) AS active_risk_coverage_auc, count(DISTINCT CASE WHEN metric = 'active_macro_f1' AND beneficial AND holm_reject THEN split_family END) = 3 AND count(DISTINCT CASE WHEN metric = 'active_risk_coverage_auc' AND beneficial AND holm_reject THEN split_family END) = 3 AS passed FROM cf GROUP BY ALL"))
def k1(spark, sf_dir):
    return reports.candidate_eval(_comparisons(spark, sf_dir))


def _both_sides(spark, sf_dir, required: list[str]):
    """Comparisons whose risks fall where their F1 rises, and the table by tau with an early side of its own."""
    c = _comparisons(spark, sf_dir)
    c = c.withColumn("estimate", F.when(F.col("metric") == "active_macro_f1", F.col("estimate")).otherwise(-F.col("estimate")))
    c = c.withColumn("beneficial", inference.beneficial(F.col("metric"), F.col("estimate"), ("active_risk_coverage_auc",)))
    c = c.withColumn("beneficial_and_holm_significant", F.col("beneficial") & F.col("holm_reject"))
    early = c.withColumn("metric", F.when(F.col("metric") == "active_macro_f1", reports.SAFETY[0]).otherwise(reports.SAFETY[1]))
    return c, reports.instability_by_tau(c, early, required)


@query("k4_universal_taus", sql.query(CMP, BOTH, body="SELECT dataset_id, tau FROM bt WHERE split_family = 'f1' AND k = 2 AND harmful = 0 AND n >= 2"))
def k4(spark, sf_dir):
    return reports.universal_taus(_both_sides(spark, sf_dir, ["f1"])[1], ["f1"])


@query("k6_dataset_overview", sql.query(CMP, BOTH, """un AS (SELECT dataset_id, string_agg(tau, '|' ORDER BY tau) AS universal_taus, count(*) AS nu FROM (SELECT dataset_id, tau FROM bt WHERE split_family IN ('f1', 'f2') GROUP BY ALL HAVING count(*) = 3 AND bool_and(k = 2 AND harmful = 0 AND n >= 2)) GROUP BY ALL),
bs AS (SELECT dataset_id, split_family, metric, arg_max(tau, {'s': CASE WHEN metric = 'active_risk_coverage_auc' THEN -estimate ELSE estimate END, 't': -CAST(tau AS DOUBLE)}) AS best FROM c3 WHERE split_family IN ('f1', 'f2') GROUP BY ALL),
bb AS (SELECT dataset_id, array_to_string(list_sort(list(DISTINCT best)), '|') AS best_taus, count(DISTINCT best) AS nb FROM bs GROUP BY ALL),
df AS (SELECT dataset_id, string_agg(split_family, '|' ORDER BY split_family) AS fams FROM (SELECT dataset_id, split_family FROM bs GROUP BY ALL HAVING count(DISTINCT best) > 1) GROUP BY ALL),
fo AS (SELECT dataset_id, count(DISTINCT split_family) AS observed, array_to_string(list_sort(list_filter(['f1', 'f2', 'f9'], lambda f: NOT list_contains(list(DISTINCT split_family), f))), '|') AS missing FROM bt GROUP BY ALL)""",
    body="SELECT dataset_id, any_value(observed) AS observed_families, 3 AS required_families, round(max(gap), 6) AS worst_confidence_gap, round(max(gap), 6) AS worst_earliest_gap, round(min(mt), 6) AS lowest_confidence_match, round(min(mt), 6) AS lowest_earliest_match, max(harmful) AS worst_safety_harmful, any_value(missing) AS missing_families, coalesce(any_value(universal_taus), '') AS universal_taus, coalesce(any_value(nu), 0) AS n_universal_taus, any_value(best_taus) AS best_taus, any_value(nb) AS n_best_taus, coalesce(any_value(fams), '') AS disagreement_families, CASE WHEN any_value(universal_taus) IS NULL THEN 'fixed_tau_unstable' ELSE 'fixed_tau_supported' END AS story FROM bt LEFT JOIN un USING (dataset_id) LEFT JOIN bb USING (dataset_id) LEFT JOIN df USING (dataset_id) JOIN fo USING (dataset_id) WHERE split_family IN ('f1', 'f2') GROUP BY dataset_id"))
def k6(spark, sf_dir):
    """One of the required families has no rows."""
    required = ["f1", "f2", "f9"]
    c, by_tau = _both_sides(spark, sf_dir, required)
    return r6(reports.dataset_overview(by_tau, c, required), "worst_confidence_gap", "worst_earliest_gap", "lowest_confidence_match", "lowest_earliest_match")


@query("k2_candidate_rank", sql.query(sql.U, body="SELECT unit::VARCHAR || policy AS candidate_id, n > 30 AS passed FROM un ORDER BY n > 30 DESC, n % 5 DESC, n % 3 DESC, metric DESC, budget, candidate_id LIMIT 1"))
def k2(spark, sf_dir):
    u = views.unit_metrics(spark, sf_dir).select(F.concat(F.col("unit").cast("string"), "policy").alias("candidate_id"), (F.col("n") > 30).alias("passed"), (F.col("n") % 5).alias("taus"), (F.col("n") % 3).alias("cells"), F.col("metric").alias("active_macro_f1"), F.col("budget").alias("active_risk_coverage_auc"))
    return reports.candidate_rank(u).select("candidate_id", "passed")


def _comparability(spark, sf_dir):
    """Parts as comparisons; all criteria vary, some are blank."""
    p = views.table(spark, sf_dir, "part")
    words = lambda *w: F.array(*map(F.lit, w))
    level = lambda k, w: F.element_at(w, ((F.floor(F.col("p_partkey") / k) % F.size(w)) + 1).cast("int"))
    three, mostly = words("exact", "related", ""), words("exact", "exact", "Exact ", "exact", "other")
    rows = p.select(
        F.col("p_partkey").alias("comparison_id"), F.col("p_brand").alias("target_id"), F.when(F.col("p_size") % 10 == 0, "boundary").when(F.col("p_size") % 10 == 1, "context").otherwise("comparator").alias("role"),
        level(5, mostly).alias("dataset"), level(1, three).alias("task_family"), level(7, mostly).alias("split_shift"), level(3, three).alias("population"), level(11, mostly).alias("adaptation"), level(13, mostly).alias("decision_object"), level(2, words("Convertible", "exact", "none")).alias("metric"), F.col("p_retailprice").alias("value"),
    )
    return reports.comparability(rows)


LEVELS = """ct AS (SELECT p_partkey AS comparison_id, p_brand AS target_id, p_size % 10 AS s, (p_partkey % 3) AS tf, ((p_partkey // 3) % 3) AS pop, (p_partkey // 5) % 5 = 4 AS ds, (p_partkey // 7) % 5 = 4 AS sh, (p_partkey // 11) % 5 = 4 AS ad, (p_partkey // 13) % 5 = 4 AS dc, (p_partkey // 2) % 3 = 2 AS me, p_retailprice AS value FROM part),
cl AS (SELECT *, CASE WHEN s = 0 THEN 'boundary' WHEN s = 1 THEN 'contextual' WHEN tf = 0 AND pop = 0 AND NOT ds AND NOT sh AND NOT ad AND NOT dc AND NOT me THEN 'direct' WHEN NOT ds AND tf < 2 AND pop < 2 THEN 'partial' ELSE 'not_comparable' END AS comparability FROM ct)"""


@query("k13_comparability", sql.query(LEVELS, body="SELECT comparison_id, comparability, comparability <> 'direct' AS claim_blocked, list_sort(list_filter([CASE WHEN ds THEN 'dataset' END, CASE WHEN tf > 0 THEN 'task_family' END, CASE WHEN sh THEN 'split_shift' END, CASE WHEN pop > 0 THEN 'population' END, CASE WHEN ad THEN 'adaptation' END, CASE WHEN dc THEN 'decision_object' END, CASE WHEN me THEN 'metric' END], lambda x: x IS NOT NULL))::VARCHAR AS blocking FROM cl"))
def k13(spark, sf_dir):
    c = _comparability(spark, sf_dir)
    fields = F.array_sort(F.filter(F.split("blocking_fields", "[|]"), lambda x: x != ""))
    return c.select("comparison_id", "comparability", "claim_blocked", F.concat(F.lit("["), F.array_join(fields, ", "), F.lit("]")).alias("blocking"))


@query("k14_comparability_summary", sql.query(LEVELS, body="SELECT target_id, " + ", ".join(f"count(*) FILTER (WHERE comparability = '{x}') AS n_{x}" for x in ("direct", "partial", "not_comparable", "contextual", "boundary")) + " FROM cl GROUP BY ALL"))
def k14(spark, sf_dir):
    return reports.comparability_summary(_comparability(spark, sf_dir))


def _targets(spark, sf_dir):
    b = views.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("target_id")).agg((F.max("p_retailprice") - 5).alias("local"), F.count(F.lit(1)).alias("n"))
    t = b.select("target_id", F.when(F.col("n") % 5 != 0, F.col("local")).alias("local"), (F.col("n") % 7 != 0).alias("observed"), F.lit(True).alias("higher"), (F.col("n") % 2 == 0).alias("eligible"), (F.col("n") % 3 == 0).alias("stats_ready"))
    return reports.target_status(t, _comparability(spark, sf_dir))


TARGETS = "tb AS (SELECT p_brand AS target_id, max(p_retailprice) - 5 AS local, count(*) AS n FROM part GROUP BY ALL), td AS (SELECT target_id, count(*) AS k, max(value) AS best FROM cl WHERE comparability = 'direct' GROUP BY ALL)"


STATUS = "ts AS (SELECT tb.target_id, CASE WHEN n % 7 = 0 THEN 'missing_local_result' WHEN n % 5 = 0 THEN 'missing_local_metric' WHEN k IS NULL THEN 'not_established_no_direct_anchor' WHEN NOT local > best THEN 'not_established_direct_anchor_not_beaten' WHEN n % 2 <> 0 THEN 'candidate_direct_numeric_win_benchmark_only' WHEN n % 3 <> 0 THEN 'candidate_direct_numeric_win_pending_stats' ELSE 'candidate_direct_sota' END AS status, n % 2 = 0 AS eligible FROM tb LEFT JOIN td ON tb.target_id = td.target_id)"


@query("k15_target_status", sql.query(LEVELS, TARGETS, STATUS, body="SELECT target_id, status FROM ts"))
def k15(spark, sf_dir):
    return _targets(spark, sf_dir).select("target_id", "status")


@query("k16_overall_status", sql.query(LEVELS, TARGETS, STATUS, body="""SELECT CASE WHEN bool_or(status LIKE 'missing_local%') THEN 'blocked_primary_evidence_incomplete'
WHEN NOT bool_or(eligible) THEN 'claim_safe_benchmark_only'
WHEN bool_or(eligible AND status = 'candidate_direct_numeric_win_pending_stats') THEN 'direct_numeric_win_pending_stats'
WHEN bool_or(eligible AND status = 'candidate_direct_sota') AND bool_and(NOT eligible OR status = 'candidate_direct_sota') THEN 'direct_comparable_sota_supported'
WHEN bool_or(eligible AND status = 'not_established_direct_anchor_not_beaten') THEN 'claim_safe_non_sota' ELSE 'claim_safe_benchmark_only' END AS status FROM ts"""))
def k16(spark, sf_dir):
    return reports.overall_status(_targets(spark, sf_dir), "provisionally_ready")
