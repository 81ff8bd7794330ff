"""Position sizing, stops, drawdown control and circuit breakers, a table at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions import bounded, ratio, zero_if_null
from barline.functions.cols import rows
from barline.plans.series import block_window, core_rows, number_rows, running, split_blocks
from barline.sources.stored import stage

# The default limits.
RISK_PER_TRADE, MAX_POSITION, MAX_EXPOSURE = 0.02, 0.10, 0.20
KELLY_SHARE, ATR_STOPS, TRAIL, MAX_DRAWDOWN = 0.25, 2.0, 0.05, 0.10
MAX_ERRORS, ERROR_SECONDS = 5, 60
LEVELS = ["normal", "warn", "soft_halt", "hard_halt"]
TRADE_BUCKET = 86400


def whole(c: Column) -> Column:
    """Truncation toward zero; NULL beyond the range of a bigint, which ``least`` passes over."""
    return c.try_cast("long")


def fixed_fraction_size(capital: str = "capital", entry: str = "entry", stop: str = "stop") -> Column:
    risk = F.abs(F.col(entry) - F.col(stop))
    by_risk = whole(ratio(F.col(capital) * RISK_PER_TRADE, risk))
    by_value = whole(ratio(F.col(capital) * MAX_POSITION, entry))
    return F.when(risk == 0, F.lit(1).cast("long")).otherwise(
        F.greatest(F.least(by_risk, by_value), F.lit(1).cast("long")))


def kelly_size(df: DataFrame, fractional: bool = True) -> DataFrame:
    """Needs entry, stop, target, capital, win_probability."""
    p = F.col("win_probability")
    df = (df.withColumn("_risk", F.abs(F.col("entry") - F.col("stop")))
          .withColumn("payoff_ratio", zero_if_null(ratio(F.abs(F.col("target") - F.col("entry")), "_risk"))))
    b = F.col("payoff_ratio")
    live = F.col("_risk") > 0
    full = F.when(live & (b > 0), ratio(p * b - (1 - p), b)).otherwise(0.0)
    df = (df.withColumn("kelly_fraction", full)
          .withColumn("edge", F.when(live, p * b - (1 - p)).otherwise(0.0))
          .withColumn("fraction", bounded(F.col("kelly_fraction") * (KELLY_SHARE if fractional else 1.0),
                                          0.0, MAX_POSITION)))
    shares = F.least(whole(ratio(F.col("capital") * F.col("fraction"), "_risk")),
                     whole(ratio(F.col("capital") * MAX_POSITION, "entry")))
    return df.withColumn("risk_amount", F.col("capital") * F.col("fraction")).withColumn(
        "position_size", F.when(F.col("fraction") > 0, F.greatest(shares, F.lit(0).cast("long")))
        .otherwise(F.lit(0).cast("long"))).drop("_risk")


def kelly_history(trades: DataFrame, window: int = 100, min_rows: int = 10,
                  block_rows: int | None = None) -> DataFrame:
    """Win rate and payoff over the last trades of each symbol; defaults without history."""
    df = trades if "rn" in trades.columns else number_rows(trades, ("symbol",), ("ts", "id"),
                                                           TRADE_BUCKET)
    df = split_blocks(df, window - 1, block_rows=block_rows)
    f = rows(block_window(), window)
    pnl = F.col("pnl")
    n = F.count("pnl").over(f)
    win = F.avg(F.when(pnl > 0, pnl)).over(f)
    loss = F.avg(F.when(pnl < 0, -pnl)).over(f)
    rate = F.avg(F.when(pnl > 0, 1.0).when(pnl.isNotNull(), 0.0)).over(f)
    df = (df.withColumn("win_rate", F.when(n < min_rows, 0.5).otherwise(rate))
          .withColumn("payoff", F.when(n < min_rows, 1.5).otherwise(F.coalesce(ratio(win, loss), F.lit(1.5)))))
    return core_rows(df).select("symbol", "id", "win_rate", "payoff")


def atr_stop(df: DataFrame, multiple: float = ATR_STOPS) -> DataFrame:
    """Stop at a multiple of ATR, target at twice that distance; needs entry, atr, is_long."""
    side = F.when(F.col("is_long"), 1.0).otherwise(-1.0)
    stop = F.col("entry") - side * F.col("atr") * multiple
    return df.withColumn("stop", stop).withColumn(
        "target", F.col("entry") + (F.col("entry") - F.col("stop")) * 2)


def trailing_stop(path: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Stop per bar of each position (symbol): only ever moves with the trade.

    Needs ts, close, first_stop, is_long per row. The rule is monotone, so it is a running
    maximum or minimum.
    """
    df = path if "rn" in path.columns else number_rows(path)
    up = F.greatest(F.col("first_stop"), F.col("close") * (1 - TRAIL))
    down = F.least(F.col("first_stop"), F.col("close") * (1 + TRAIL))
    df = running(df, {"_hi": ("max", up), "_lo": ("min", down)}, block_rows=block_rows)
    return df.select("symbol", "ts", F.when(F.col("is_long"), F.col("_hi"))
                     .otherwise(F.col("_lo")).alias("stop"))


def with_streak(df: DataFrame, keys=("symbol",), block_rows: int | None = None) -> DataFrame:
    """Losing trades in a row: losses since the last trade that was none.

    Needs ``rn`` and ``pnl``; rows without pnl (other events) leave the streak alone.
    """
    loss = F.when(F.col("pnl") < 0, 1).otherwise(0).cast("long")
    return running(df, {"loss_streak": ("since", loss, F.col("pnl") >= 0)}, keys, block_rows)


def loss_streak(trades: DataFrame, block_rows: int | None = None) -> DataFrame:
    df = number_rows(trades, ("symbol",), ("ts", "id"), TRADE_BUCKET,
                     keep_bucket=block_rows is None)
    return with_streak(df, block_rows=block_rows).select("symbol", "id", "pnl", "loss_streak")


def daily_pnl(trades: DataFrame) -> DataFrame:
    return trades.groupBy("symbol", F.to_date("ts").alias("day")).agg(
        F.sum("pnl").alias("pnl"), F.sum(F.when(F.col("pnl") < 0, F.col("pnl")).otherwise(0.0))
        .alias("realised_loss"))


def drawdown_size(size: str = "position_size", drawdown: str = "drawdown") -> Column:
    dd = F.col(drawdown)
    scaled = whole(F.col(size) * F.greatest(F.lit(0.5), 1 - dd / MAX_DRAWDOWN))
    return F.when(dd >= MAX_DRAWDOWN, F.lit(0).cast("long")).otherwise(scaled)


def exposure_ok(current: Column, added: Column, capital: str = "capital") -> Column:
    return zero_if_null(ratio(current + added, capital)) <= MAX_EXPOSURE


def exposure_check(candidates: DataFrame, positions: DataFrame) -> DataFrame:
    """Whether a new position keeps total exposure inside the limit."""
    held = positions.filter("status = 'OPEN'").agg(
        zero_if_null(F.sum(F.col("current_price") * F.col("quantity"))).alias("current_exposure"))
    df = candidates.join(F.broadcast(held))  # one row
    return df.withColumn("within_limit", exposure_ok(F.col("current_exposure"), F.col("new_value")))


def evaluate_trade(df: DataFrame) -> DataFrame:
    """All checks on a candidates table: entry, stop, target, capital, win_probability, drawdown,
    current_exposure, can_trade."""
    df = kelly_size(df).withColumn("_sized", drawdown_size())
    value = F.col("_sized") * F.col("entry")
    fits = exposure_ok(F.col("current_exposure"), value)
    df = df.withColumn("_final", F.when(fits, F.col("_sized")).otherwise(whole(F.col("_sized") * 0.5)))
    reason = (F.when(~F.col("can_trade"), "trading halted")
              .when(F.col("edge") <= 0, "negative edge")
              .when(F.col("_final") <= 0, "position too small").otherwise("OK"))
    reward = F.abs(F.col("target") - F.col("entry"))
    risk = F.abs(F.col("entry") - F.col("stop"))
    df = df.withColumn("reason", reason).withColumn("approved", F.col("reason") == "OK")
    return (df.withColumn("position_size", F.when(F.col("approved"), F.col("_final"))
                          .otherwise(F.lit(0).cast("long")))
            .withColumn("risk_reward", zero_if_null(ratio(reward, risk))).drop("_sized", "_final"))


# ---- time-range windows ----------------------------------------------------------------------

def time_blocks(df: DataFrame, reach_seconds: int, block_seconds: int, ts: str = "ts") -> DataFrame:
    """Cuts each key's rows into time blocks that also hold the ``reach`` before them."""
    us = F.unix_micros(F.col(ts))
    own = F.floor(us / (block_seconds * 1_000_000))
    last = F.floor((us + reach_seconds * 1_000_000) / (block_seconds * 1_000_000))
    return (df.withColumn("_us", us).withColumn("_tb", F.explode(F.sequence(own, last)))
            .withColumn("_own", F.col("_tb") == own))


def trailing_count(df: DataFrame, cond: Column, seconds: int, name: str, *keys: str,
                   block_seconds: int | None = None) -> DataFrame:
    """Rows with ``cond`` in the last ``seconds`` up to and including the row's own time."""
    block_seconds = block_seconds or max(900, 8 * seconds)  # copies stay below an eighth
    w = Window.partitionBy(*keys, "_tb").orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    out = time_blocks(df, seconds, block_seconds).withColumn(name, F.count(F.when(cond, 1)).over(w))
    return out.filter("_own").drop("_us", "_tb", "_own")


def rate_window(requests: DataFrame, limit: int, seconds: int = 60, key: str = "key") -> DataFrame:
    """Requests in the sliding window and whether the limit was exceeded."""
    out = trailing_count(requests, F.lit(True), seconds, "in_window", key)
    return out.withColumn("over_limit", F.col("in_window") > limit)


def raw_level(starting_equity: float, max_errors: int = MAX_ERRORS) -> Column:
    """Ordinal of the level that errors, streak and the day's loss call for."""
    e, s, d = F.col("errors"), F.col("loss_streak"), F.abs(F.col("day_loss"))
    return (F.when((e >= max_errors) | (s >= 5), 3)
            .when((d > starting_equity * MAX_DRAWDOWN) | (s >= 3), 2)
            .when(e >= max_errors // 2, 1).otherwise(0))


def breaker_level(log: DataFrame, starting_equity: float = 100_000.0, seconds: int = ERROR_SECONDS,
                  block_rows: int | None = None, daily_reset: bool = False, max_errors: int = MAX_ERRORS,
                  carried: DataFrame | None = None, lent: str | None = None) -> DataFrame:
    """Breaker level after each log row (symbol, ts, id, kind, pnl). Levels only escalate, until a row
    of kind ``reset`` sets level, streak and errors back; with ``daily_reset`` a soft halt ends with its day.

    To go on from earlier days, ``carried`` gives symbol, streak and level at their end, and rows with
    ``lent`` are older ones that lend their errors and resets to the error window but have no level of their own.
    """
    manual = F.col("kind") == "reset"
    own = ~F.col(lent) if lent else F.lit(True)
    df = log.select("symbol", "ts", "id", "kind", "pnl", own.alias("_mine"))
    df = stage(number_rows(df, ("symbol",), ("ts", "id"), by_rows=True), "breaker-log")
    mine = F.col("_mine")
    df = running(df, {"_reset": ("sum", manual.cast("long")), "_part": ("sum", (manual & mine).cast("long"))}, block_rows=block_rows)
    df = trailing_count(df, F.col("kind") == "error", seconds, "errors", "symbol", "_reset")
    df = df.where(mine).withColumn("_day", F.to_date("ts"))
    loss = F.when(F.col("pnl") < 0, F.col("pnl")).otherwise(0.0)
    df = running(df, {"day_loss": ("sum", loss)}, ("symbol", "_day"), block_rows)
    ends = (F.coalesce(F.col("pnl") >= 0, F.lit(False))) | manual
    df = running(df, {"loss_streak": ("since", F.when(F.col("pnl") < 0, 1).otherwise(0).cast("long"), ends), "_ended": ("max", ends.cast("long"))},
                 block_rows=block_rows)
    if carried is None:
        df = df.withColumn("_level0", F.lit(0))
    else:
        start = carried.select("symbol", F.col("streak").alias("_streak0"), F.col("level").alias("_level0"))
        df = (df.join(start, "symbol", "left").withColumn("_level0", F.coalesce("_level0", F.lit(0)))
              .withColumn("loss_streak", F.col("loss_streak") + F.when(F.col("_ended") == 0, F.coalesce("_streak0", F.lit(0))).otherwise(0)))
    df = df.withColumn("_raw", raw_level(starting_equity, max_errors))
    start = F.when(F.col("_part") == 0, F.col("_level0")).otherwise(0)
    if daily_reset:
        keys = ("symbol", "_part")
        df = running(stage(df, "breaker-state"), {"_high": ("max", F.col("_raw"))}, keys, block_rows)
        df = running(df, {"_today": ("max", F.least(F.col("_raw"), F.lit(2)))}, (*keys, "_day"), block_rows)
        # The last earlier day that called for anything: a warning stays, a soft halt is over. A row per day.
        days = df.groupBy(*keys, "_day").agg(F.max("_today").alias("_called"))
        before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
        days = days.select(*keys, "_day", F.last(F.when(F.col("_called") > 0, F.col("_called")), ignorenulls=True).over(before).alias("_last"))
        df = df.join(days, [*keys, "_day"])
        level = (F.when((F.col("_high") == 3) | (start == 3), 3).when(F.col("_today") == 2, 2)
                 .when((F.col("_today") == 1) | (F.coalesce(F.col("_last"), start) == 1), 1).otherwise(0))
    else:
        df = running(stage(df, "breaker-state"), {"_high": ("max", F.col("_raw"))}, ("symbol", "_part"), block_rows)
        level = F.greatest(F.col("_high"), start)
    names = F.array(*[F.lit(x) for x in LEVELS])
    return df.select("symbol", "ts", "id", "kind", "errors", "loss_streak", "day_loss",
                     F.element_at(names, level.cast("int") + 1).alias("level"))


def breaker_days(levels: DataFrame) -> DataFrame:
    """Streak and level at the end of each day of :func:`breaker_level`, from which a later day can go on."""
    names = F.array(*[F.lit(x) for x in LEVELS])
    last = F.max_by(F.struct("loss_streak", "level"), F.struct("ts", "id"))
    return levels.groupBy("symbol", F.to_date("ts").alias("day")).agg(last.alias("_l")).select(
        "symbol", "day", F.col("_l.loss_streak").alias("streak"), (F.array_position(names, F.col("_l.level")) - 1).cast("int").alias("level"))
