"""Queries of fitted models: temporal forest, stacked blend."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import metrics, scoring, sequences, splits
from heddle.plans import sql
from heddle.sources import views

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


# sequences: each modality's channels (as SQL) and mask

MODALITIES = [
    (["abs(value)", "abs(label)"], "(NOT invalid)::INT"),
    (["t % 7", "t % 5"], "(t % 3 <> 0)::INT"),
    (["value * 2"], "((NOT invalid)::INT + (t % 2 = 0)::INT) / 2"),
    (["value", "-value", "label"], "(t % 4 < 3)::INT"),
    (["label * value"], "record_id % 2"),
    (["t % 2"], "1"),
]


def _channels() -> str:
    return "\nUNION ALL ".join(f"SELECT row_id, i, {m} AS m, {c} AS c, ({v})::DOUBLE AS v, ({k})::DOUBLE AS k FROM sq" for m, (channels, k) in enumerate(MODALITIES) for c, v in enumerate(channels))


def _numbered() -> str:
    """The place of each number of the summaries after two tabular features."""
    out, base = [], 2
    for m, (channels, _) in enumerate(MODALITIES):
        n = len(channels)
        where = f"FROM st WHERE m = {m}"
        out += [f"SELECT row_id, {base} + c AS k, mean AS x {where}", f"SELECT row_id, {base + n} + c, deviation {where}", f"SELECT row_id, {base + 2 * n} + c, delta {where}", f"SELECT row_id, {base + 3 * n}, available {where} AND c = 0"]
        base += 3 * n + 1
        for q in range(4):
            out += [f"SELECT row_id, {base} + c, mean{q} {where}", f"SELECT row_id, {base + n}, available{q} {where} AND c = 0"]
            base += n + 1
    return "\nUNION ALL ".join(out)


SEQUENCES = f"""sq AS (SELECT *, record_id * 100000 + t // 16 AS row_id, t % 16 AS i FROM x QUALIFY count(*) OVER (PARTITION BY record_id, t // 16) = 16),
ch AS ({_channels()}),
mn AS (SELECT row_id, m, c, sum(v * k) / greatest(sum(k), 1) AS mean FROM ch GROUP BY ALL),
st AS (SELECT ch.row_id, ch.m, ch.c, any_value(mean) AS mean, sqrt(sum(((v - mean) * k) ** 2) / greatest(sum(k), 1)) AS deviation,
  coalesce(arg_max(v, i) FILTER (WHERE k > 0), any_value(v) FILTER (WHERE i = 0)) - coalesce(arg_min(v, i) FILTER (WHERE k > 0), any_value(v) FILTER (WHERE i = 0)) AS delta, greatest(sum(k), 1) / 16 AS available,
  {", ".join(f"sum(v * k) FILTER (WHERE i // 4 = {q}) / greatest(sum(k) FILTER (WHERE i // 4 = {q}), 1) AS mean{q}, greatest(sum(k) FILTER (WHERE i // 4 = {q}), 1) / 4 AS available{q}" for q in range(4))}
  FROM ch JOIN mn USING (row_id, m, c) GROUP BY ALL)"""


@query("e1e_temporal_features", sql.query(sql.X, SEQUENCES, body=f"SELECT row_id, k, round(x, 6) AS x FROM ({_numbered()})\nUNION ALL SELECT row_id, 0, count(*) FILTER (WHERE label > 0) FROM sq GROUP BY ALL\nUNION ALL SELECT row_id, 1, any_value(record_id % 3) FROM sq GROUP BY ALL"))
def e1e_features(spark, sf_dir):
    f = sequences.temporal_features(views.sequences(spark, sf_dir))
    return f.select("row_id", F.posexplode("features").alias("k", "x")).select("row_id", F.col("k").cast("long").alias("k"), F.round("x", 6).alias("x"))


@query("e1e_temporal_forest")
def e1e(spark, sf_dir):
    s = views.sequences(spark, sf_dir).withColumn("half", F.col("row_id") % 2)
    return scoring.temporal_forest(s, lambda rows: splits.leave_one_group_out(rows, "half"), 2).select("split_id", "row_id", "role", F.transform("p", lambda x: F.round(x, 6)).alias("p"))


VALIDATION = """va AS (SELECT * FROM t WHERE event_id % 10 = 0 AND subject_id <> 'S03'),
bl AS (SELECT split_id, label, weight, list_transform(range(5), lambda i: (1 - weight) * p_user[i + 1] + weight * p_assist[i + 1]) AS p FROM va, (SELECT unnest([0.0, 0.15, 0.30, 0.45, 0.60, 0.75, 1.0]) AS weight)),
bx AS (SELECT *, list_position(p, list_max(p)) - 1 AS x FROM bl),
bc AS (SELECT split_id, weight, label AS c, (x = label)::INT AS tp FROM bx UNION ALL SELECT split_id, weight, x, 0 FROM bx),
bf AS (SELECT split_id, weight, avg(f) AS macro_f1 FROM (SELECT split_id, weight, c, 2 * sum(tp) / count(*) AS f FROM bc GROUP BY ALL) GROUP BY ALL),
ba AS (SELECT split_id, weight, avg((x = label)::INT) AS accuracy, avg(-ln(p[label + 1])) AS loss FROM bx GROUP BY ALL),
bw AS (SELECT split_id, weight, row_number() OVER (PARTITION BY split_id ORDER BY macro_f1 DESC, accuracy DESC, loss, weight) AS k FROM bf JOIN ba USING (split_id, weight)),
ch AS (SELECT split_id, coalesce(weight, 0.5) AS weight FROM (SELECT DISTINCT split_id FROM t) LEFT JOIN (SELECT split_id, weight FROM bw WHERE k = 1) USING (split_id)),
bp AS (SELECT split_id, weight, label, list_transform(range(5), lambda i: (1 - weight) * p_user[i + 1] + weight * p_assist[i + 1]) AS p FROM t JOIN ch USING (split_id) WHERE event_id % 10 > 0)"""


@query("e1f_blend_by_split", sql.query(sql.T, VALIDATION, body="SELECT split_id, weight, count(*) AS n, round(avg((list_position(p, list_max(p)) - 1 = label)::INT), 6) AS accuracy, round(avg(-ln(p[label + 1])), 6) AS nll FROM bp GROUP BY ALL"))
def e1f(spark, sf_dir):
    """Weights chosen on a tenth of each split's traces; one subject's split has none there."""
    from heddle.functions.arrays import argmax

    t = views.traces(spark, sf_dir)
    tenth = F.col("event_id") % 10 == 0
    weights = scoring.choose_blends(t, t.where(tenth & (F.col("subject_id") != "S03")))
    b = scoring.blend_posteriors(t.where(~tenth), weights).join(weights, "split_id")
    hit = F.avg((argmax(F.col("p")) == F.col("label")).cast("double"))
    return b.groupBy("split_id", "weight").agg(F.count(F.lit(1)).alias("n"), F.round(hit, 6).alias("accuracy"), F.round(F.avg(metrics.nll(F.col("p"), F.col("label"))), 6).alias("nll"))


@query("e1f_stacked_blend_fit")
def e1f_fit(spark, sf_dir):
    """Random trees on the tabular features and the fusion network on the sequences, blended split by split."""
    s = views.sequences(spark, sf_dir).withColumn("half", F.col("row_id") % 2)
    out = scoring.stacked_blend(s, lambda rows: splits.leave_one_group_out(rows, "half"), ("extra_trees", "fusion"), 2)
    return out.select("split_id", "row_id", "role", F.transform("p", lambda x: F.round(x, 6)).alias("p"))
