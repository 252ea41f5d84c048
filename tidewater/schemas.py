"""Schemas of inputs; hot paths never infer them."""

from __future__ import annotations

INDICATOR_SERIES = "ts timestamp, value double"
PRICE_BARS = "ts timestamp, open double, high double, low double, close double, volume double"
TRADES = "exchange string, trade_id string, price double, size double, ts timestamp, side string, is_maker boolean"
ORDERBOOK = "exchange string, ts timestamp, bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>"
WHALE_TRANSACTIONS = "tx_hash string, from_address string, to_address string, amount double, ts timestamp, is_exchange boolean, direction string, exchange_name string"
FUNDING_RATES = "exchange string, symbol string, funding_rate double, predicted_funding_rate double, ts timestamp, funding_interval int"
OPTIONS_FLOW = "ts timestamp, strike double, expiry string, option_type string, volume double, open_interest double, implied_volatility double, delta double, gamma double, theta double, vega double, is_unusual boolean"
RAW_MESSAGE = "source string, parser string, payload string, ingest_ts timestamp"
TICK = "symbol string, ts timestamp, price double, volume double, bid double, ask double, source string"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
