"""Plan shape: what is shuffled, what is pushed down, where Python runs."""

import re

from barline.operators import features, indicators as ind
from barline.plans.series import number_rows
from barline.sources.derived import bars_series
from barline.operators.tables import scan_bars

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hash_exchanges(text):
    return len(re.findall(r"Exchange hashpartitioning", text))


def test_one_exchange_for_stored_bars(spark):
    bars = bars_series(spark, SF)
    for df in (ind.sma(bars, 20, 200), ind.bollinger(bars), ind.macd(bars), ind.adx(bars)):
        text = plan(df)
        assert hash_exchanges(text) == 1
        assert "Python" not in text and "Pandas" not in text


def test_one_sort_per_exchange_for_averages(spark):
    text = plan(ind.macd(bars_series(spark, SF)))
    assert text.count("Sort [") == 1


def test_partition_by_block_not_by_symbol(spark):
    text = plan(ind.sma(bars_series(spark, SF), 20))
    assert re.search(r"hashpartitioning\(symbol#\d+, blk#\d+", text)


def test_scan_pushes_filters_and_columns(spark):
    text = plan(scan_bars(bars_series(spark, SF), "A-F", "1996-01-01", "1997-01-01"))
    assert "EqualTo(symbol,A-F)" in text and "GreaterThanOrEqual(ts" in text
    assert "rn:" not in text


def test_unused_indicators_leave_the_plan(spark):
    bars = bars_series(spark, SF)
    few = plan(features.all_indicators(bars).select("symbol", "ts", "sma_20"))
    assert "ema_26" not in few and "_gain_63" not in few


def test_numbering_does_not_put_a_symbol_in_one_task(spark):
    text = plan(number_rows(bars_series(spark, SF).drop("rn", "n")))
    assert re.search(r"hashpartitioning\(symbol#\d+, _bk#\d+", text)


def test_numbering_by_rows_spreads_one_day_over_all_tasks(spark):
    from pyspark.sql import functions as F
    ticks = spark.range(20_000).select(F.lit("A").alias("symbol"), F.timestamp_seconds(F.col("id") % 5_000).alias("ts"), "id")
    fold = "spark.sql.adaptive.coalescePartitions.enabled"  # as it is with more rows than fit a partition
    spark.conf.set(fold, "false")
    try:
        df = number_rows(ticks.repartition(7), ("symbol",), ("ts", "id"), by_rows=True, keep_bucket=True, with_total=True)
    finally:
        spark.conf.unset(fold)
    text = plan(df)
    assert re.search(r"hashpartitioning\(symbol#\d+, _bk#\d+", text)
    sizes = [r["count"] for r in df.groupBy("blk").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 10_000  # as many ranges as the session has shuffle partitions
    rows = df.orderBy("rn").collect()
    assert [r.rn for r in rows] == list(range(20_000)) and {r.n for r in rows} == {20_000}
    assert [(r.ts, r.id) for r in rows] == sorted((r.ts, r.id) for r in rows)
