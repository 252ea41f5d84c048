"""The catalogue of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) -> DataFrame, and the DuckDB statement of the same result."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def r6(x: Column | str) -> Column:
    """Rounded to six places, without negative zero; the shift keeps exact ties from falling either way."""
    return F.round((F.col(x) if isinstance(x, str) else x) + F.lit(1e-9), 6) + F.lit(0.0)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """All double columns of ``df`` but ``keep`` rounded to six places."""
    return df.select(*[r6(n).alias(n) if t == "double" and n not in keep else F.col(n) for n, t in df.dtypes])


#: SQL of the logical series, as in tidewater.sources.tables.
HOURLY = """bars AS (SELECT event_type AS k, date_trunc('hour', ts) AS t, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)"""
DAILY = HOURLY.replace("'hour'", "'day'")
TRADES = """trades AS (SELECT l_returnflag AS k, l_shipdate AS t, l_extendedprice / l_quantity AS price, l_quantity AS size,
  CASE WHEN l_returnflag = 'N' THEN 'buy' ELSE 'sell' END AS side, l_linestatus = 'F' AS is_maker, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)"""
WHALES = """whales AS (SELECT o_orderpriority AS exchange, o_orderdate AS t, o_totalprice AS amount,
  CASE o_orderstatus WHEN 'F' THEN 'inflow' WHEN 'O' THEN 'outflow' ELSE 'internal' END AS direction, o_custkey AS address, o_orderkey AS seq FROM orders)"""
W = "PARTITION BY k ORDER BY t"

# p-values in SQL, by Simpson's rule over POINTS steps
POINTS = 2000
_SIMPSON = f"list_sum(list_transform(range(0, {POINTS + 1}), lambda at_: (CASE WHEN at_ IN (0, {POINTS}) THEN 1 WHEN at_ % 2 = 1 THEN 4 ELSE 2 END) * ({{f}})))"


def beta_sql(x: str, a: str, b: str) -> str:
    """The regularised incomplete beta function, as an integral over the angle whose squared sine runs to x."""
    step = f"(asin(sqrt({x})) / {POINTS})"
    f = f"power(sin(at_ * {step}), 2 * ({a}) - 1) * power(cos(at_ * {step}), 2 * ({b}) - 1)"
    return f"({_SIMPSON.format(f=f)} * 2 * {step} / 3 / exp(lgamma({a}) + lgamma({b}) - lgamma(({a}) + ({b}))))"


def t_p_sql(t: str, df: str) -> str:
    return beta_sql(f"({df}) / (({df}) + ({t}) * ({t}))", f"({df}) / 2.0", "0.5")


def f_p_sql(f: str, d1: str, d2: str) -> str:
    return beta_sql(f"({d2}) / (({d2}) + ({d1}) * ({f}))", f"({d2}) / 2.0", f"({d1}) / 2.0")


def f_p2_sql(f: str, d1: str, d2: str) -> str:
    p = f_p_sql(f, d1, d2)
    return f"(2 * least({p}, 1 - {p}))"


def chi2_p_sql(x: str, df: int) -> str:
    """The tail beyond x, over the root."""
    s = f"(sqrt({x}) + at_ * 12.0 / {POINTS})"
    f = f"power({s}, {df - 1}) * exp(-{s} * {s} / 2)"
    return f"({_SIMPSON.format(f=f)} * 12.0 / {POINTS} / 3 / (power(2.0, {df / 2 - 1}) * exp(lgamma({df / 2}))))"
