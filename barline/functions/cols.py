"""Column helpers. Spark runs in ANSI mode, so every division goes through try_divide."""

from __future__ import annotations

import re

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as a double, NULL when b is 0."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def filled(c: Column | str, default) -> Column:
    return F.coalesce(as_col(c), F.lit(default))


def zero_if_null(c: Column | str) -> Column:
    return F.coalesce(as_col(c), F.lit(0.0))


def bounded(c: Column | str, lo: float, hi: float) -> Column:
    """Clip that keeps NULL (greatest and least skip NULLs on their own)."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(hi)), F.lit(lo)))


def full(agg: Column, x: Column | str, w: WindowSpec, size: int) -> Column:
    """A rolling aggregate that stays NULL until the frame holds ``size`` values."""
    return F.when(F.count(as_col(x)).over(w) == size, agg)


def rows(w: WindowSpec, size: int) -> WindowSpec:
    return w.rowsBetween(-(size - 1), Window.currentRow)


def corr_agg(x: Column | str, y: Column | str, default: float | None = 0.0) -> Column:
    """Pearson correlation as an aggregate; ``default`` where it is undefined."""
    x, y = as_col(x).cast("double"), as_col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    c = _corr(F.covar_samp(xs, ys), F.stddev_samp(xs), F.stddev_samp(ys),
              F.min(xs), F.max(xs), F.min(ys), F.max(ys))
    return c if default is None else F.coalesce(c, F.lit(default))


def corr_over(x: Column | str, y: Column | str, w: WindowSpec,
              default: float | None = 0.0) -> Column:
    x, y = as_col(x).cast("double"), as_col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    c = _corr(F.covar_samp(xs, ys).over(w), F.stddev_samp(xs).over(w), F.stddev_samp(ys).over(w),
              F.min(xs).over(w), F.max(xs).over(w), F.min(ys).over(w), F.max(ys).over(w))
    return c if default is None else F.coalesce(c, F.lit(default))


def _corr(cov, sx, sy, x0, x1, y0, y1) -> Column:
    # min < max is the exact test for variance; a rounded sd may not be 0 on constant input
    return F.when((x0 < x1) & (y0 < y1), F.try_divide(cov, sx * sy))


def sd_ratio(mean: Column, sd: Column, lo: Column, hi: Column) -> Column:
    """mean / sd, NULL on constant input."""
    return F.when(lo < hi, F.try_divide(mean, sd))


UNITS = {"min": 60, "minute": 60, "t": 60, "hour": 3600, "h": 3600, "day": 86400, "d": 86400,
         "week": 604800, "w": 604800, "sec": 1, "second": 1, "s": 1}


def timeframe_seconds(timeframe: str) -> int:
    """'1Day', '4Hour', '15Min' -> seconds."""
    m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]+?)s?\s*", timeframe)
    if not m or m.group(2).lower() not in UNITS:
        raise ValueError(f"unknown timeframe {timeframe!r}")
    return int(m.group(1)) * UNITS[m.group(2).lower()]
