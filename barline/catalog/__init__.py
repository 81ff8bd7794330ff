from barline.catalog import indicators, features, tables, labels, quality, stats, scores, risk, models, streams  # noqa: F401
from barline.catalog.base import ORACLES, QUERIES  # noqa: F401
