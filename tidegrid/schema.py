"""Declared schemas and fixed codes of the canonical order book frame."""

from __future__ import annotations

from pyspark.sql import types as T

# Codes of a book update's action and side.
ADD, CANCEL, MODIFY, TRADE, FILL, CLEAR = 0, 1, 2, 3, 4, 5
BID, ASK, NONE = 1, -1, 0
#: Undefined price in fixed-point vendor records; becomes NULL at the boundary.
UNDEFINED_PRICE = 2**63 - 1

KEYS = ["window_id", "event_type", "stage", "time_et", "instrument"]
DEPTH_LEVELS = (1, 3, 5, 10)


def book_schema(levels: int = 1) -> T.StructType:
    """One row per update, the state after it; prices in whole ticks, times in ns, missing prices NULL."""
    head = "window_id string, instrument string, seq bigint, ts_event bigint, action tinyint, side tinyint, price bigint, size bigint"
    book = ", ".join(f"bid_px_{i} bigint, ask_px_{i} bigint, bid_sz_{i} bigint, ask_sz_{i} bigint" for i in range(levels))
    return T.StructType.fromDDL(f"{head}, {book}")


STAGES = "window_id string, event_type string, stage string, time_et string, t0_ns bigint"
CALENDAR = "event_id string, event_type string, tier int, date date, stage string, time_et string, t0_utc_ns bigint, t0_utc string, source string"
CONTROLS = "control_id string, time_et string, date date, weekday string, t0_utc_ns bigint, t0_utc string"
MEETINGS = "date string, statement_time_et string, press_conference_time_et string, source_url string"
SURPRISE_TEXT = "event_id string, event_type string, release_date string, variable string, actual string, consensus string, prior string, unit string, source_url string, notes string"
VINTAGES = "realtime_start date, date date, value double"
DEFINITIONS = "instrument_id bigint, raw_symbol string, tick_size double, multiplier double, expiration_ns bigint"


def levels_of(columns: list[str]) -> int:
    """Number of book levels of a frame, by its column names."""
    return sum(c.startswith("bid_px_") for c in columns)
