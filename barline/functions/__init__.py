from barline.functions.cols import (  # noqa: F401
    bounded, corr_agg, corr_over, filled, full, ratio, sd_ratio, timeframe_seconds, zero_if_null,
)
from barline.functions.normal import norm_cdf, norm_cdf_sql, norm_ppf, norm_ppf_sql  # noqa: F401
