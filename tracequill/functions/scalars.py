"""Scalar expressions of the trace model; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def number_text(x: Column) -> Column:
    """A number as a script would print it: no exponent, no trailing zeros."""
    text = x.cast("decimal(20,3)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")


def operation_key(operation_id: str = "operation_id", channel: str = "channel", ts: str = "ts_ms") -> Column:
    return F.coalesce(F.col(operation_id), F.concat_ws(":", F.col(channel), number_text(F.col(ts))))


def time_to_ms(x: Column) -> Column:
    """Epoch numbers by magnitude: nanoseconds from 1e16, microseconds from 1e13, else milliseconds."""
    v = x.cast("double")
    return F.when(v >= 1e16, v / 1e6).when(v >= 1e13, v / 1e3).otherwise(v)


def severity(score: Column) -> Column:
    return F.when(score >= 0.7, "critical").when(score >= 0.35, "warning").otherwise("info")


def percentile(p: float, value: str, accuracy: int | None = None) -> Column:
    """Nearest-rank percentile of the non-null values; approximate where an accuracy is given.

    The exact form keeps a count per distinct value of a group; give an accuracy for groups with
    more distinct values than an executor holds.
    """
    if accuracy:
        return F.expr(f"approx_percentile({value}, {p}D, {accuracy})")
    return F.expr(f"percentile_disc({p}D) WITHIN GROUP (ORDER BY {value})")


def percent_change(a: Column, b: Column) -> Column:
    return F.when(a > 0, (b - a) / a * 100).otherwise(0.0)


def cache_state(maps: Column) -> Column:
    """Inline-cache state by the number of maps seen."""
    return F.when(maps == 0, "uninitialized").when(maps == 1, "monomorphic").when(maps <= 4, "polymorphic").otherwise("megamorphic")


#: Prefixes of channels that make run-specific noise, by kind.
NOISE_PREFIXES = {
    "gc-pause": ("node:v8.gc", "v8.gc", "gc:"),
    "timer-jitter": ("timer", "node:timers", "timers"),
    "network-dns": ("dns", "dns.lookup"),
    "tcp-handshake": ("net:", "node:net", "tcp", "http.get"),
}


def noise_kind(signature: Column, prefixes: dict[str, tuple[str, ...]] = NOISE_PREFIXES) -> Column:
    """Kind of run-specific noise by the channel's prefix, or null."""
    any_of = lambda starts: F.greatest(*(signature.startswith(x) for x in starts), F.lit(False))
    return F.coalesce(*(F.when(any_of(starts), kind) for kind, starts in prefixes.items()))
