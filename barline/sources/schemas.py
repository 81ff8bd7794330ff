"""Declared schemas of the stored tables, as DDL."""

from __future__ import annotations

BARS = (
    "symbol string, ts timestamp, open double, high double, low double, close double, "
    "volume bigint")
MARKET_BARS = (
    "symbol string, ts timestamp, open double, high double, low double, close double, "
    "volume bigint, vwap double, trade_count int")
TRADES = (
    "symbol string, ts timestamp, price double, size bigint, exchange string")
QUOTES = (
    "symbol string, ts timestamp, bid_price double, ask_price double, bid_size bigint, "
    "ask_size bigint")
FEATURE_STORE = (
    "symbol string, ts timestamp, feature_name string, feature_value double, "
    "feature_version string, created_at timestamp")
SENTIMENT_SCORES = (
    "symbol string, ts timestamp, source string, headline string, sentiment_score double, "
    "confidence double, classification string, model_name string, raw_response string")
TRADING_SIGNALS = (
    "symbol string, ts timestamp, signal_type string, direction string, strength double, "
    "technical_score double, sentiment_score double, fundamental_score double, "
    "confluence_score double, model_version string, metadata string")
SYSTEM_METRICS = (
    "ts timestamp, metric_name string, metric_value double, labels string")
POSITIONS = (
    "id bigint, symbol string, quantity int, entry_price double, current_price double, "
    "exit_price double, stop_loss double, take_profit double, position_type string, "
    "entry_time timestamp, exit_time timestamp, pnl double, pnl_pct double, status string")
