"""Recheck intervals. `as_of` is always given; times are naive (TIMESTAMP_NTZ), unparsable ones count as absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, WatchConfig
from .urls import col, is_first_phase_listing


def parse_time(x) -> Column:
    return F.try_to_timestamp(col(x)).cast("timestamp_ntz")


def checked_at(last_checked, found_at) -> Column:
    """The stored time of the last check, or of discovery if that text is empty."""
    return parse_time(F.coalesce(F.nullif(col(last_checked), F.lit("")), col(found_at)))


def due(at, as_of, minutes: int) -> Column:
    """Age of at least so many minutes, or no known time."""
    return F.coalesce(col(at) <= col(as_of) - F.expr(f"INTERVAL '{minutes}' MINUTE"), F.lit(True))


def must_fetch(status, at, as_of, url, config: WatchConfig = DEFAULT) -> Column:
    """The gate before a fetch: new and unknown states always, listing and home pages always, others by age."""
    s = col(status)
    return (
        F.when(s.isNull() | is_first_phase_listing(url), True)
        .when(s.isin("HIT", "NOWE", "ZMIANA"), due(at, as_of, 60 * config.hit_hours))
        .when(s == "NO_MATCH", due(at, as_of, 60 * config.no_match_hours))
        .when(s == "BLOCKED", due(at, as_of, config.blocked_minutes))
        .when(s == "FAILED", due(at, as_of, config.failed_minutes))
        .otherwise(True)
    )


def still_seen(at, as_of, days: int) -> Column:
    """Kept by a purge: a known time, no older than so many days."""
    return F.coalesce(col(at) >= col(as_of) - F.expr(f"INTERVAL '{days}' DAY"), F.lit(False))
