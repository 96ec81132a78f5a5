"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from heddle.plans import model_queries, policy_queries, report_queries, table_queries

QUERIES: dict = policy_queries.QUERIES | table_queries.QUERIES | report_queries.QUERIES | model_queries.QUERIES
ORACLES: dict = policy_queries.ORACLES | table_queries.ORACLES | report_queries.ORACLES | model_queries.ORACLES
