"""Registry of named queries: a Spark callable ``(spark, sf_dir) -> DataFrame``
and, where one exists, the equivalent SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.exprs import round_doubles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def half_up_sql(sql: str) -> str:
    """Rewrite every ``round(<expr>, 6)`` of an oracle query into the explicit
    half-up form that ``functions.exprs.half_up`` uses on the Spark side."""
    out, i, key = [], 0, "round("
    low = sql.lower()
    while True:
        j = low.find(key, i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                break
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k, comma = 1, j + len(key), -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner = half_up_sql(sql[j + len(key):comma])
        places = int(sql[comma + 1:k - 1].strip())
        m = f"1e{places}"
        out.append(sql[i:j])
        out.append(f"(CASE WHEN abs(CAST({inner} AS DOUBLE)) < 1e12 THEN floor(CAST({inner} AS DOUBLE) * {m} + 0.5) / {m} "
                   f"ELSE CAST({inner} AS DOUBLE) END)")
        i = k
    return "".join(out)


def register(name: str, sql: str | None = None):
    """Register ``fn`` under ``name``; the result's doubles are rounded to six
    places so that results compare independently of summation order."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = half_up_sql(sql)
        return fn
    return deco


# The transaction view in DuckDB SQL (same definition as sources.tables.tx_view).
TX_CTE = """tx AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS hash,
         CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS BIGINT) AS block_number,
         l_linenumber AS tx_index,
         o_custkey AS from_addr,
         l_partkey AS to_addr,
         CASE WHEN l_discount = 0 THEN 0.0 ELSE l_extendedprice / 1000 END AS value_eth,
         21000 + CAST(l_quantity AS BIGINT) * 100 AS gas,
         1000000000 + ((l_suppkey * 7919 + l_partkey) % 1000) * 1000000 AS gas_price,
         l_linenumber AS nonce,
         CAST(l_returnflag = 'R' AS INTEGER) AS is_error,
         o_orderdate + to_seconds(CAST((l_partkey * 37) % 3600 AS BIGINT)) AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

EVENTS_CTE = """tx AS (
  SELECT CAST(event_id AS VARCHAR) AS hash, CAST(0 AS BIGINT) AS block_number, 0 AS tx_index,
         user_id AS from_addr, event_type AS to_addr, value AS value_eth,
         CAST(21000 AS BIGINT) AS gas, CAST(1000000000 AS BIGINT) AS gas_price, 0 AS nonce,
         CAST(event_type = 'error' AS INTEGER) AS is_error, ts
  FROM events)"""


def with_tx(body: str, cte: str = TX_CTE) -> str:
    """``WITH tx AS (...), <body>``; ``body`` starts with further CTEs or SELECT."""
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return f"WITH {cte}\n{body}"
    return f"WITH {cte},\n{body}"
