"""Registry of queries: the Spark callable and the SQL that checks it side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
EXACT = 2.0 ** 53


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles on a grid whose borders sit off .5, where prices often land exactly.

    From 2^53 grid steps on a double has no such digits: it stays as it is.
    """
    scale = float(10 ** digits)
    x = F.col
    return df.select(*[F.when(F.abs(x(c)) < EXACT / scale, F.floor(x(c) * scale + 0.37) / scale)
                       .otherwise(x(c)).alias(c) if t == "double" else x(c) for c, t in df.dtypes])


def register(name: str, oracle: str | None = None, rnd: str = "", digits: int = 6):
    """``rnd`` names the oracle's double columns; both sides round them to ``digits``."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(prepare(spark), sf_dir), digits)
        run.__name__ = name
        assert name not in QUERIES, name
        QUERIES[name] = run
        if oracle is not None:
            repl = ", ".join(f"CASE WHEN abs(CAST({c} AS DOUBLE)) < {EXACT!r} / 1e{digits} "
                             f"THEN floor(CAST({c} AS DOUBLE) * 1e{digits} + 0.37e0) / 1e{digits} "
                             f"ELSE CAST({c} AS DOUBLE) END AS {c}" for c in rnd.split())
            ORACLES[name] = f"SELECT * REPLACE ({repl}) FROM (\n{oracle}\n)" if repl else oracle
        return fn
    return wrap


# Daily bars of the oracle; every market query starts from them.
BARS = """bars AS (
  SELECT l_returnflag || '-' || l_linestatus AS symbol, date_trunc('day', l_shipdate) AS ts,
         arg_min(l_extendedprice / l_quantity, row(l_shipdate, l_orderkey, l_linenumber, l_partkey % 1000000)) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         arg_max(l_extendedprice / l_quantity, row(l_shipdate, l_orderkey, l_linenumber, l_partkey % 1000000)) AS close,
         CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM lineitem GROUP BY 1, 2)"""
NUMBERED = BARS + """,
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn,
             count(*) OVER (PARTITION BY symbol) AS n FROM bars)"""


def full_sql(agg: str, x: str, p: int, src: str = "") -> str:
    f = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) {f} = {p} THEN {agg}({x}) {f} END)"


def std_sql(x: str, p: int) -> str:
    f = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"
    return (f"(CASE WHEN count({x}) {f} = {p} THEN CASE WHEN min({x}) {f} < max({x}) {f} "
            f"THEN stddev_samp({x}) {f} ELSE 0e0 END END)")


def lag_sql(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY symbol ORDER BY ts)"


def zscore_sql(x: str, p: int) -> str:
    f = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"
    return (f"coalesce(CASE WHEN count({x}) {f} = {p} AND min({x}) {f} < max({x}) {f} "
            f"THEN ({x} - avg({x}) {f}) / stddev_samp({x}) {f} END, 0e0)")
