"""Registered queries: name, Spark plan, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}

#: The market tables derived from events, as CTEs.
PRELUDE = """
e0 AS (SELECT event_id AS seq, epoch_us(ts) * 1000 AS ts_ns, user_id, user_id % 2 AS sym, event_type, value FROM events),
e AS (SELECT *, ((ts_ns % 237600000000000) - (ts_ns % 21600000000000)) // 21600000000000 AS bk FROM e0),
ev AS (SELECT *, 100e0 + 0.5e0 * ((bk * 7) % 11) AS mid FROM e),
snap AS (SELECT seq, sym, ts_ns, user_id, event_type, mid, mid - 0.5e0 AS bid, mid + 0.5e0 AS ask,
    (1 + seq % 5)::DOUBLE AS bsz, (1 + seq % 3)::DOUBLE AS asz,
    list_transform(range(10), lambda l: {'px': mid - 0.5e0 * (l + 1), 'sz': (CASE WHEN l = 0 THEN 1 + seq % 5 ELSE 1 + (seq * (l + 3)) % 5 END)::DOUBLE}) AS bids,
    list_transform(range(10), lambda l: {'px': mid + 0.5e0 * (l + 1), 'sz': (CASE WHEN l = 0 THEN 1 + seq % 3 ELSE 1 + (seq * (l + 4)) % 5 END)::DOUBLE}) AS asks
  FROM ev WHERE event_type IN ('view', 'click', 'signup')),
trade AS (SELECT seq, sym, ts_ns, user_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS side,
    mid + 0.5e0 * (CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END) AS price, (1 + floor(value)::BIGINT % 8)::DOUBLE AS size
  FROM ev WHERE event_type IN ('purchase', 'error'))"""


def sql(text: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([PRELUDE, *ctes]) + "\n" + text


def query(oracle: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan under its function's name."""
    def add(plan: Plan) -> Plan:
        QUERIES[plan.__name__] = plan
        if oracle:
            ORACLES[plan.__name__] = oracle
        return plan
    return add
