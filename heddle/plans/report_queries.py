"""Queries over candidates, anchors, manifests, charts and files, derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import inference, reports
from heddle.operators import signal as sig
from heddle.plans import sql
from heddle.plans.table_queries import CMP, _comparisons, r6
from heddle.sources import files, store, views

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


# candidates: one per market segment pair of comparisons and units

UNITS = """mu AS (SELECT 'c' || (l_partkey % 3) AS candidate_id, 'f' || (l_linenumber % 2) AS split_family, l_suppkey % 20 AS subject_id,
 CASE WHEN l_orderkey % 3 = 0 THEN 'agency_margin_tau_' WHEN l_orderkey % 3 = 1 THEN 'set_acsa_tau_' ELSE 'user_only' END || CASE WHEN l_orderkey % 3 < 2 THEN CASE WHEN l_orderkey % 2 = 0 THEN '0.05' ELSE '0.10' END ELSE '' END AS policy,
 avg(l_discount) AS active_macro_f1, avg(l_tax) AS active_risk_coverage_auc FROM lineitem GROUP BY ALL)"""


def _units(spark, sf_dir):
    """Units of three candidates: a margin and a set policy at two budgets, and the user alone."""
    k = F.col("l_orderkey")
    tau = F.when(k % 3 == 2, "").when(k % 2 == 0, "0.05").otherwise("0.10")
    policy = F.concat(F.when(k % 3 == 0, "agency_margin_tau_").when(k % 3 == 1, "set_acsa_tau_").otherwise("user_only"), tau)
    name = lambda prefix, c, n: F.concat(F.lit(prefix), (F.col(c) % n).cast("string"))
    g = views.table(spark, sf_dir, "lineitem").groupBy(name("c", "l_partkey", 3).alias("candidate_id"), name("f", "l_linenumber", 2).alias("split_family"), (F.col("l_suppkey") % 20).alias("subject_id"), policy.alias("policy"))
    return g.agg(F.avg("l_discount").alias("active_macro_f1"), F.avg("l_tax").alias("active_risk_coverage_auc")).withColumn("day", F.lit(None).cast("string"))


GOOD = CMP + """,
gd AS (SELECT *, CASE WHEN metric = 'active_macro_f1' THEN estimate ELSE -estimate END AS signed FROM cmp),
pq AS (SELECT dataset_id AS candidate_id, split_family, metric, tau, signed AS estimate, CASE WHEN metric = 'active_macro_f1' THEN signed > 0 ELSE signed < 0 END AS beneficial, abs(signed) > 0.0092 AS holm_reject, gap FROM gd)"""


def _signed(spark, sf_dir):
    c = _comparisons(spark, sf_dir)
    c = c.withColumn("estimate", F.when(F.col("metric") == "active_macro_f1", F.col("estimate")).otherwise(-F.col("estimate")))
    return c.withColumn("beneficial", inference.beneficial(F.col("metric"), F.col("estimate"), ("active_risk_coverage_auc",))).withColumn("holm_reject", F.abs("estimate") > 0.0092)


@query("k1_candidate_summary", sql.query(GOOD, UNITS, """fc AS (SELECT candidate_id, count(DISTINCT split_family) AS split_family_count, count(*) FILTER (WHERE metric = 'active_macro_f1' AND beneficial AND holm_reject) AS active_f1_cells, count(*) FILTER (WHERE metric <> 'active_macro_f1' AND beneficial AND holm_reject) AS active_risk_cells FROM pq GROUP BY ALL),
qt AS (SELECT candidate_id, string_agg(tau, '|' ORDER BY tau) AS taus, count(*) AS k FROM (SELECT candidate_id, tau FROM pq JOIN fc USING (candidate_id) WHERE beneficial AND holm_reject GROUP BY candidate_id, tau, split_family_count HAVING count(DISTINCT split_family || metric) = 2 * split_family_count) GROUP BY ALL),
ag AS (SELECT 'd' || substr(candidate_id, 2) AS candidate_id, max(active_macro_f1) AS f1, min(active_risk_coverage_auc) AS risk FROM mu WHERE policy LIKE 'agency%' GROUP BY ALL)"""
, body="SELECT candidate_id, coalesce(taus, '') AS qualifying_taus, coalesce(k, 0) AS qualifying_tau_count, coalesce(k, 0) > 0 AS all_families_passed, coalesce(active_f1_cells, 0) AS active_f1_cells, coalesce(active_risk_cells, 0) AS active_risk_cells, coalesce(split_family_count, 0) AS split_family_count, round(f1, 6) AS best_active_macro_f1, round(risk, 6) AS best_active_risk_coverage_auc FROM ag LEFT JOIN fc USING (candidate_id) LEFT JOIN qt USING (candidate_id)"))
def k1(spark, sf_dir):
    rows = _signed(spark, sf_dir).withColumnRenamed("dataset_id", "candidate_id")
    aggregate = _units(spark, sf_dir).withColumn("candidate_id", F.concat(F.lit("d"), F.substring("candidate_id", 2, 9)))
    return r6(reports.candidate_summary(rows, aggregate), "best_active_macro_f1", "best_active_risk_coverage_auc")


PAIRED = """lo AS (SELECT split_family, subject_id, policy, unnest(['active_macro_f1', 'active_risk_coverage_auc']) AS metric, unnest([active_macro_f1, active_risk_coverage_auc]) AS value FROM (SELECT split_family, subject_id, policy, avg(active_macro_f1) AS active_macro_f1, avg(active_risk_coverage_auc) AS active_risk_coverage_auc FROM mu GROUP BY ALL)),
pr AS (SELECT a.split_family, a.metric, a.policy AS policy_a, b.policy AS policy_b, a.value - b.value AS d FROM lo a JOIN lo b ON a.split_family = b.split_family AND a.subject_id = b.subject_id AND a.metric = b.metric WHERE a.policy LIKE 'agency%' AND (b.policy = 'user_only' OR b.policy LIKE 'set%' AND right(a.policy, 4) = right(b.policy, 4)))"""


@query("j10_report_tables", sql.query(UNITS, PAIRED, body="SELECT CASE WHEN policy_b = 'user_only' THEN 'vs_user_only' ELSE 'matched_tau' END AS comparison_family, split_family, metric, policy_a, policy_b, 'subject_id' AS unit_cols, round(avg(d), 6) AS estimate, count(*) AS n, CASE WHEN metric = 'active_macro_f1' THEN avg(d) > 0 ELSE avg(d) < 0 END AS beneficial, true AS inside, 2::BIGINT AS n_tests FROM pr GROUP BY split_family, metric, policy_a, policy_b"))
def j10(spark, sf_dir):
    t = inference.report_tables(_units(spark, sf_dir), ["split_id", "subject_id", "session", "day"], list(reports.PRIMARY), reports.LOWER)
    inside = (F.col("ci_low") <= F.col("estimate")) & (F.col("estimate") <= F.col("ci_high")) & F.col("p_value").between(0, 1) & (F.col("holm_rank") <= F.col("n_tests"))
    return r6(t.select("comparison_family", "split_family", "metric", "policy_a", "policy_b", "unit_cols", "estimate", "n", "beneficial", inside.alias("inside"), "n_tests"), "estimate")


# anchors and manifests

OBSERVED = """ob AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'main' WHEN n_nationkey % 3 = 1 THEN 'second' ELSE 'third' END AS dataset_id, c_nationkey, avg(c_acctbal) / 10000 AS u, max(c_acctbal) / 10000 AS a, min(c_acctbal) / 10000 + 0.6 AS g, stddev_pop(c_acctbal) / 10000 AS ga FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


@query("k8_anchor_checks", sql.query(GOOD, OBSERVED, """rj AS (SELECT * FROM pq WHERE candidate_id = 'd0' AND holm_reject),
tq AS (SELECT tau FROM rj WHERE beneficial GROUP BY tau HAVING count(DISTINCT split_family || metric) = 2 * (SELECT count(DISTINCT split_family) FROM rj))"""
, body="""SELECT 'exclusion_matched' AS "check", bool_or(s_name = 'Supplier#000000001') AS passed, true AS critical FROM supplier
UNION ALL SELECT 'multimodal_direction', bool_and(a > u), true FROM ob WHERE dataset_id = 'main' UNION ALL SELECT 'performance_floor', max(g) >= 0.2, true FROM ob WHERE dataset_id = 'main' UNION ALL SELECT 'active_floor', max(ga) >= 0.45, true FROM ob WHERE dataset_id = 'main'
UNION ALL SELECT 'external_direction', bool_and(g > u), false FROM ob WHERE dataset_id IN ('second', 'third')
UNION ALL SELECT 'manifest_alignment', bool_and(c_nationkey IS NOT DISTINCT FROM s_nationkey), false FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey
UNION ALL SELECT 'primary_significance', count(*) > 0, true FROM tq"""))
def k8(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg((F.avg("c_acctbal") / 10000).alias("user_macro_f1"), (F.max("c_acctbal") / 10000).alias("assist_macro_f1"), (F.min("c_acctbal") / 10000 + 0.6).alias("best_agency_macro_f1"), (F.stddev_pop("c_acctbal") / 10000).alias("best_agency_active_macro_f1"))
    k = F.col("c_nationkey") % 3
    seen = c.withColumn("dataset_id", F.when(k == 0, "main").when(k == 1, "second").otherwise("third"))
    pairs = _signed(spark, sf_dir).withColumn("dataset_id", F.when(F.col("dataset_id") == "d0", "main").otherwise("second"))
    return reports.anchor_checks(seen, pairs, "main", ["second", "third"], views.table(spark, sf_dir, "supplier").select("s_name"), "Supplier#000000001", _aligned(spark, sf_dir))


def _aligned(spark, sf_dir):
    manifest = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("model"))
    config = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("model"))
    return reports.config_alignment(manifest, config, "key", ["model"])


@query("k9_config_alignment", "SELECT s_suppkey AS key, s_nationkey AS model, c_nationkey AS config_model, s_nationkey IS NOT DISTINCT FROM c_nationkey AS matches_config FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey")
def k9(spark, sf_dir):
    return _aligned(spark, sf_dir)


@query("k10_manifest_violations", """WITH mf AS (SELECT o_custkey AS id, CASE WHEN o_custkey % 7 = 0 THEN ' ' ELSE 'd' END AS dataset, count(*) AS traces, sum(o_orderkey % 3)::BIGINT AS decisions, count(*) AS n_fam, count(DISTINCT o_orderstatus) AS d_fam, CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 3 END AS repeats FROM orders GROUP BY o_custkey)
SELECT id, unnest(list_filter([CASE WHEN dataset = ' ' THEN 'dataset is blank' END, CASE WHEN decisions < 1 THEN 'decision_count is below 1' END, CASE WHEN coalesce(repeats, 0) < 1 THEN 'pairwise_repeats is below 1' END, CASE WHEN d_fam < n_fam THEN 'split_families repeat' END, CASE WHEN decisions < traces THEN 'fewer decisions than traces' END], lambda x: x IS NOT NULL)) AS rule FROM mf""")
def k10(spark, sf_dir):
    k = F.col("o_custkey")
    m = views.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("trace_count"), F.sum(F.col("o_orderkey") % 3).alias("decision_count"), F.collect_list("o_orderstatus").alias("split_families"))
    m = m.select(k.alias("id"), F.when(k % 7 == 0, " ").otherwise("d").alias("dataset"), F.lit("root").alias("prepared_root"), F.lit("u").alias("user_model"), F.lit("a").alias("assist_model"), F.when(k % 5 > 0, k % 3).alias("pairwise_repeats"), "trace_count", "decision_count", "split_families")
    return reports.manifest_violations(m, "publication", "id")


@query("k10_json_manifests", """WITH g AS (SELECT o_orderpriority AS p, count(*) AS n, count(DISTINCT o_orderstatus) AS fams FROM orders GROUP BY ALL)
SELECT p AS dataset, unnest(list_filter([CASE WHEN p LIKE '1%' THEN 'prepared_root is blank' END, CASE WHEN p LIKE '2%' THEN 'decision_count is below 1' END, CASE WHEN p LIKE '3%' THEN 'fewer decisions than traces' END], lambda x: x IS NOT NULL)) AS rule FROM g""")
def k10_json(spark, sf_dir):
    """A manifest for each priority, written as a JSON file of its own and read back; one lacks a root, one has text for a number, one too few decisions."""
    root, p = store.scratch(spark, "manifests"), F.col("o_orderpriority")
    g = views.table(spark, sf_dir, "orders").groupBy(p.alias("dataset")).agg(F.count(F.lit(1)).alias("trace_count"), F.array_sort(F.collect_set("o_orderstatus")).alias("split_families"))
    d = F.col("dataset")
    m = g.withColumns({"prepared_root": F.when(d.startswith("1"), " ").otherwise("root"), "user_model": F.lit("u"), "assist_model": F.lit("a"), "pairwise_repeats": F.lit(2000), "decision_count": F.when(d.startswith("2"), "many").when(d.startswith("3"), "1").otherwise((F.col("trace_count") * 18).cast("string"))})
    number = F.when(F.col("decision_count") == "many", F.lit('"many"')).otherwise(F.col("decision_count"))
    text = F.regexp_replace(F.to_json(F.struct(*[c for c in m.columns if c != "decision_count"])), "[}]$", "")
    files_of = m.select(F.concat(text, F.lit(',"decision_count":'), number, F.lit("}")).alias("value"), F.sha2("dataset", 256).alias("name"))
    files_of.repartition("name").write.partitionBy("name").text(root)
    found = reports.manifest_violations(reports.read_manifests(spark, root, "publication"), "publication")
    return store.small_result(found, root)


@query("k17_signed_benefit", sql.query(GOOD, body="SELECT candidate_id AS dataset_id, split_family, metric, tau, round(CASE WHEN metric = 'active_macro_f1' THEN estimate ELSE -estimate END, 6) AS benefit, round(CASE WHEN metric = 'active_macro_f1' THEN estimate - gap ELSE -(estimate + 2 * gap) END, 6) AS benefit_low, round(CASE WHEN metric = 'active_macro_f1' THEN estimate + 2 * gap ELSE -(estimate - gap) END, 6) AS benefit_high FROM pq"))
def k17(spark, sf_dir):
    gap = F.col("mean_abs_intervention_rate_gap")
    rows = _signed(spark, sf_dir).withColumns({"ci_low": F.col("estimate") - gap, "ci_high": F.col("estimate") + 2 * gap})
    return r6(reports.signed_benefit(rows).select("dataset_id", "split_family", "metric", "tau", "benefit", "benefit_low", "benefit_high"), "benefit", "benefit_low", "benefit_high")


@query("k17_match_counts", sql.query(CMP, "se AS (SELECT 'd' || (l_suppkey % 2) AS dataset_id, 'f' || (l_linenumber % 3) AS split_family, format('{:.2f}', 0.05 * (1 + l_partkey % 3)) AS tau, count(*) FILTER (WHERE l_quantity > 25) AS exact_n, count(*) AS total_n FROM lineitem GROUP BY ALL)", body="SELECT c.dataset_id, c.split_family, c.tau, any_value(exact_n) AS exact_n, any_value(total_n) AS total_n FROM cmp c LEFT JOIN se USING (dataset_id, split_family, tau) WHERE c.split_family <> 'f0' GROUP BY ALL"))
def k17b(spark, sf_dir):
    """One tau of the comparisons has no selections."""
    li = views.table(spark, sf_dir, "lineitem")
    chosen = li.select(F.concat(F.lit("d"), (F.col("l_suppkey") % 2).cast("string")).alias("dataset_id"), F.concat(F.lit("f"), (F.col("l_linenumber") % 3).cast("string")).alias("split_family"), F.format_string("%.2f", F.lit(0.05) * (1 + F.col("l_partkey") % 3)).alias("tau"), (F.col("l_quantity") > 25).alias("exact_budget_match"))
    c = _comparisons(spark, sf_dir)
    by_tau = reports.instability_by_tau(c, c.withColumn("metric", F.lit(reports.SAFETY[0])), ["f1", "f2"])
    return reports.match_counts(by_tau, chosen).select("dataset_id", "split_family", "tau", "exact_n", "total_n")


# stress levels


@query("c18_missing_modality", "SELECT missing, round(sum(CASE WHEN missing = 'size' THEN 0 ELSE p_size END), 2) AS p_size, round(sum(CASE WHEN missing = 'price' THEN 0 ELSE p_retailprice END), 2) AS p_retailprice FROM part, (SELECT unnest(['size', 'price']) AS missing) GROUP BY missing")
def c18(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    s = sig.missing_modality_stress(p, {"size": ["p_size"], "price": ["p_retailprice"]})
    return s.groupBy("missing").agg(F.round(F.sum("p_size"), 2).alias("p_size"), F.round(F.sum("p_retailprice"), 2).alias("p_retailprice"))


@query("c18_noise_stress", "SELECT snr_db, count(*) AS n, true AS near FROM embeddings, (SELECT unnest([30.0::DOUBLE, 10.0::DOUBLE]) AS snr_db) GROUP BY snr_db")
def c18b(spark, sf_dir):
    """near: whether the noise's mean power lies within a tenth of what the level asks."""
    f = views.features(spark, sf_dir).withColumn("clean", F.col("features"))
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)
    noise = F.zip_with("features", "clean", lambda x, y: x - y)
    s = sig.noise_stress(f, "vec_id", [30, 10], 3).groupBy("snr_db").agg(F.count(F.lit(1)).alias("n"), (F.sum(square(noise)) / F.sum(square(F.col("clean")))).alias("share"))
    return s.select("snr_db", "n", (F.abs(F.col("share") * F.pow(F.lit(10.0), F.col("snr_db") / 10) - 1) < 0.1).alias("near"))


# files


@query("a3_records_sink", sql.query(sql.T, body="SELECT subject_id, count(*) AS n, sum(label)::BIGINT AS labels, round(sum(p_user[1]), 6) AS p0, count(DISTINCT day) AS days FROM t GROUP BY ALL"))
def a3(spark, sf_dir):
    """Traces written as CSV, vectors as JSON text, and read back."""
    path = store.scratch(spark, "records") + ".csv"
    files.write_report(views.traces(spark, sf_dir), path, "csv")
    back = files.read_traces(spark, path).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("labels"), F.round(F.sum(F.element_at("p_user", 1)), 6).alias("p0"), F.count_distinct("day").alias("days"))
    return store.small_result(back, path)


def _written(spark, sf_dir) -> str:
    """Order keys as one CSV file for each status, and orders as one JSON file for each priority."""
    root, o = store.scratch(spark, "files"), views.table(spark, sf_dir, "orders")
    o.select("o_orderkey", "o_orderstatus").repartition("o_orderstatus").write.partitionBy("o_orderstatus").option("header", True).csv(f"{root}/a")
    o.select("o_orderkey", "o_orderpriority").repartition("o_orderpriority").write.partitionBy("o_orderpriority").json(f"{root}/b")
    return root


@query("a6_file_inventory", "SELECT '.csv' AS extension, count(*) AS files, sum(b)::BIGINT AS bytes FROM (SELECT 11 + sum(length(o_orderkey::VARCHAR) + 1) AS b FROM orders GROUP BY o_orderstatus) UNION ALL SELECT '.json', count(*), sum(b)::BIGINT FROM (SELECT sum(length(o_orderkey::VARCHAR) + 16) AS b FROM orders GROUP BY o_orderpriority)")
def a6(spark, sf_dir):
    root = _written(spark, sf_dir)
    f = files.file_inventory(spark, root)
    checked = f.join(files.tree_digests(f, 1 << 10, 1 << 12), "path").where("length(sha256) = 64 and length(tree_sha256) = 64")
    return store.small_result(files.extension_counts(checked), root)


@query("a7_inventory_checks", "SELECT 'has csv' AS \"check\", count(*) > 0 AS passed FROM orders UNION ALL SELECT 'equal pairs', count(DISTINCT o_orderstatus) = count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'at least four', count(DISTINCT o_orderstatus) + count(DISTINCT o_orderpriority) >= 4 FROM orders UNION ALL SELECT 'has F', bool_or(o_orderstatus = 'F') FROM orders")
def a7(spark, sf_dir):
    root = _written(spark, sf_dir)
    inv = files.listed_files(spark, root)
    is_ = lambda e: F.col("extension") == e
    checks = files.inventory_checks(inv, [("has csv", F.bool_or(is_(".csv"))), ("equal pairs", F.count_if(is_(".csv")) == F.count_if(is_(".json"))), ("at least four", F.count(F.lit(1)) >= 4), ("has F", F.bool_or(F.col("path").contains("o_orderstatus=F")))])
    return store.small_result(checks, root)


@query("a8_output_manifest", "SELECT 'output' AS role, 'table' AS kind, '.csv' AS extension, count(DISTINCT o_orderstatus) AS files, count(*) AS rows FROM orders UNION ALL SELECT 'output', 'records', '.json', count(DISTINCT o_orderpriority), count(*) FROM orders UNION ALL SELECT 'config', 'config', '', 1, NULL")
def a8(spark, sf_dir):
    root = _written(spark, sf_dir)
    m = files.output_manifest(spark, root, {"taus": "0.05,0.10"}).groupBy("role", "kind", F.coalesce("extension", F.lit("")).alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"))
    return store.small_result(m, root)


HOSTS = ["://([^/]+)/([a-z]{2})/([0-9]+)", "://([^/]+)/([a-z]{2})/([^0-9].*)"]


@query("a4_path_manifests", "SELECT DISTINCT url, CASE WHEN regexp_matches(url, '://([^/]+)/([a-z]{2})/([0-9]+)') THEN 0 ELSE 1 END AS pattern, regexp_extract(url, '://([^/]+)/([a-z]{2})/(.*)', 1) AS host, regexp_extract(url, '://([^/]+)/([a-z]{2})/(.*)', 2) AS lang FROM pages WHERE regexp_matches(url, '://([^/]+)/([a-z]{2})/([0-9]+)') OR regexp_matches(url, '://([^/]+)/([a-z]{2})/([^0-9].*)')")
def a4(spark, sf_dir):
    return files.path_manifests(views.table(spark, sf_dir, "pages"), "url", HOSTS, ["host", "lang"])


@query("a4_unmatched_paths", "SELECT DISTINCT url FROM pages WHERE NOT coalesce(regexp_matches(url, '://([^/]+)/([a-z]{2})/([0-9]+)$'), false)")
def a4b(spark, sf_dir):
    return files.unmatched_paths(views.table(spark, sf_dir, "pages"), "url", [HOSTS[0] + "$"])


@query("a4_inconsistent_paths", "SELECT DISTINCT url, o AS \"outer\", i AS \"inner\" FROM (SELECT url, regexp_extract(url, '/([0-9])', 1) AS o, regexp_extract(url, '([0-9])[^0-9]*$', 1) AS i FROM pages) WHERE o <> '' AND i <> '' AND o <> i")
def a4c(spark, sf_dir):
    """The first digit of the page's number against the last one."""
    return files.inconsistent_paths(views.table(spark, sf_dir, "pages"), "url", "/([0-9])", "([0-9])[^0-9]*$")


@query("a13_forbidden_names", "SELECT DISTINCT url, suffix FROM pages, (SELECT unnest(['7', '/en/3', 'HTML']) AS suffix) WHERE ends_with(lower(url), lower(suffix))")
def a13(spark, sf_dir):
    return files.forbidden_names(views.table(spark, sf_dir, "pages"), "url", ["7", "/en/3", "HTML"])


@query("a13_missing_required", "SELECT DISTINCT c_custkey AS o_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def a13b(spark, sf_dir):
    return files.missing_required(views.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), "o_custkey", views.table(spark, sf_dir, "customer").select("c_custkey"))
