"""SQL (as DuckDB runs it) of the views and policies, from which the oracles are put together."""

from __future__ import annotations

T = """
ev AS (SELECT event_id, user_id, ts, CAST(user_id % 12 AS INT) AS sub, CAST((day(ts) - 1) // 3 AS INT) AS dk FROM events),
w0 AS (SELECT *, CAST((user_id + dk) % 5 AS INT) AS label, row_number() OVER (PARTITION BY user_id, dk ORDER BY ts, event_id) AS pr FROM ev),
w1 AS (SELECT *,
  list_transform(range(5), lambda c: 1 + (event_id * 31 + c * 17 + user_id * 7) % 97 + CASE WHEN c = label AND event_id % 10 < 6 THEN 90 ELSE 0 END) AS wu,
  list_transform(range(5), lambda c: 1 + (event_id * 13 + c * 41 + user_id * 3) % 89 + CASE WHEN c = label AND event_id % 10 < 8 THEN 120 ELSE 0 END) AS wa FROM w0),
w2 AS (SELECT event_id, 'events' AS dataset_id, 'S' || lpad(sub::VARCHAR, 2, '0') AS subject_id,
  CASE WHEN sub % 4 = 0 THEN 'target' ELSE 'background' END AS "group",
  CASE WHEN dk < 5 THEN 'session1' ELSE 'session2' END AS session, 'D' || lpad(dk::VARCHAR, 2, '0') AS day,
  user_id || ':' || dk AS episode_id, label, dk, pr / 5.0 AS prefix_time_s, epoch_us(ts) / 1e6 AS timestamp_s,
  list_transform(wu, lambda x: x / list_sum(wu)) AS p_user, list_transform(wa, lambda x: x / list_sum(wa)) AS p_assist FROM w1),
t0 AS (SELECT *, list_max(p_user) AS cu, list_max(p_assist) AS ca, list_position(p_user, list_max(p_user)) - 1 AS u, list_position(p_assist, list_max(p_assist)) - 1 AS a FROM w2),
t AS (SELECT *, 'logo|' || subject_id AS split_id FROM t0 UNION ALL SELECT *, 'forward_day|' || day AS split_id FROM t0 WHERE dk > 0)
"""

X = """
x AS (SELECT user_id AS record_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, epoch_us(ts) / 1e6 AS ts, value - 50 AS value,
  coalesce(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1, 0) AS label, event_id % 11 = 0 AS invalid FROM events)
"""

M = """
m AS (SELECT o_orderkey AS row_id, o_custkey % 50 AS subject_id, c_mktsegment AS "group", year(o_orderdate) AS session, 'day' || month(o_orderdate) AS day,
  o_orderpriority AS label_raw, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey)
"""

V = "v AS (SELECT vec_id, label, embedding FROM embeddings)"

U = "un AS (SELECT l_suppkey AS unit, l_returnflag AS policy, avg(l_discount) AS metric, avg(l_tax) AS budget, count(*) AS n FROM lineitem GROUP BY ALL)"


def margin_best(tau: float) -> str:
    return f"list_max([{{'s': p_assist[i + 1], 'm': {tau} - greatest(0.0, cu - p_user[i + 1]), 'n': -i}} for i in range(5) if {tau} - greatest(0.0, cu - p_user[i + 1]) >= -1e-12])"


def policies(taus: tuple[float, ...]) -> dict[str, tuple[str, float, str]]:
    """policy: (action, tau, coverage), over the columns of t0."""
    blend = lambda w: f"list_transform(range(5), lambda i: {1 - w} * p_user[i + 1] + {w} * p_assist[i + 1])"
    out = {"user_only": ("u", 0.0, "cu"), "assist_only": ("a", 1.0, "ca")}
    for w in (0.25, 0.5, 0.75):
        out[f"confidence_blend_alpha_{w:.2f}"] = (f"list_position({blend(w)}, list_max({blend(w)})) - 1", 1.0, f"list_max({blend(w)}) / list_sum({blend(w)})")
    for k, th in enumerate((0.6, 0.7, 0.8)):
        out[f"selective_prediction#{k}"] = (f"CASE WHEN cu < {th} AND ca >= {th} THEN a ELSE u END", 1.0, f"CASE WHEN cu < {th} AND ca >= {th} THEN ca ELSE cu END")
    for tau in taus:
        ok = f"(ca > cu AND greatest(0.0, cu - p_user[a + 1]) <= {tau})"
        out[f"set_acsa_tau_{tau:.2f}"] = (f"CASE WHEN {ok} THEN a ELSE u END", tau, f"CASE WHEN {ok} THEN ca ELSE cu END")
        best = margin_best(tau)
        out[f"agency_margin_tau_{tau:.2f}"] = (f"CASE WHEN struct_extract({best}, 's') > cu THEN -struct_extract({best}, 'n') ELSE u END", tau, f"CASE WHEN struct_extract({best}, 's') > cu THEN struct_extract({best}, 's') ELSE cu END")
    return out


def decisions(names: dict[str, tuple[str, float, str]], source: str = "t", name: str = "d") -> str:
    """CTE of decisions: one row per row of source and policy."""
    rows = "\nUNION ALL\n".join(f"SELECT *, '{p.split('#')[0]}' AS policy, CAST({x} AS INT) AS x, {tau} AS tau, {c} AS coverage FROM {source}" for p, (x, tau, c) in names.items())
    return f"{name}0 AS ({rows}),\n{name} AS (SELECT *, x <> u AS intervene, greatest(0.0, cu - p_user[x + 1]) AS ali, x = label AS correct FROM {name}0)"


def query(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body
