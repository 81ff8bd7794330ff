"""Bar rollups, scans and table maintenance over OHLCV data."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.functions import timeframe_seconds

BAR_COLUMNS = ["symbol", "ts", "open", "high", "low", "close", "volume"]


def bucket_start(ts, seconds: int):
    return F.window(ts, f"{seconds} seconds").getField("start")


def time_order(ts: str = "ts", seq: str | None = None):
    """Time and a non-negative bigint as one number. Orders of plain numbers let min_by and max_by
    run in a hash aggregate; one of structs would sort all input rows before the shuffle."""
    us = F.unix_micros(ts)
    if seq is None:
        return us
    wide = us.cast("decimal(19,0)") * F.lit(Decimal(10 ** 19)) + F.col(seq).cast("decimal(19,0)")
    return wide.cast("decimal(38,0)")


def rollup(ticks: DataFrame, timeframe: str) -> DataFrame:
    """Trades (symbol, ts, price, size, seq) to bars; ``seq``, a bigint, decides first and last on
    ties of time. Two of the same time and seq count as one moment."""
    width = timeframe_seconds(timeframe)
    order = time_order("ts", "seq")
    return (ticks.groupBy("symbol", bucket_start("ts", width).alias("bucket"))
            .agg(F.min_by("price", order).alias("open"),
                 F.max("price").alias("high"), F.min("price").alias("low"),
                 F.max_by("price", order).alias("close"),
                 F.sum("size").cast("bigint").alias("volume"))
            .withColumnRenamed("bucket", "ts")
            .select(*BAR_COLUMNS))
