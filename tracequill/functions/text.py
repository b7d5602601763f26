"""Numbers, times and causes in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bytes_text(x: Column) -> Column:
    """A size with one decimal in the largest fitting unit, up to GB."""
    step = F.greatest(F.lit(0), F.least(F.lit(3), F.floor(F.log(x) / F.log(F.lit(1024.0))))).cast("int")
    unit = F.element_at(F.array(*(F.lit(u) for u in ("B", "KB", "MB", "GB"))), step + 1)
    return F.when(x == 0, "0 B").otherwise(F.format_string("%.1f %s", F.round(x / F.pow(F.lit(1024.0), step), 1), unit))


def duration_text(ms: Column) -> Column:
    return F.when(ms < 1, F.format_string("%.0fµs", F.round(ms * 1000))).when(ms < 1000, F.format_string("%.1fms", F.round(ms, 1))).otherwise(F.format_string("%.2fs", F.round(ms / 1000, 2)))


def percent_text(share: Column) -> Column:
    return F.format_string("%.1f%%", F.round(share * 100, 1))


def time_text(ms: Column) -> Column:
    """Milliseconds since the epoch as UTC time, whatever the session's zone."""
    day = F.floor(ms / 86_400_000)
    rest = F.floor(ms - day * 86_400_000).cast("long")
    part = lambda unit, size: F.pmod(F.floor(rest / unit), F.lit(size))
    clock = F.format_string("%02d:%02d:%02d.%03d", part(3_600_000, 24), part(60_000, 60), part(1000, 60), F.pmod(rest, F.lit(1000)))
    return F.concat_ws(" ", F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy-MM-dd"), clock)


def shortened(text: Column, most: int = 80) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))


def evidence(calls: str, errors: str, error_rate: str, p95: str, avg: str, unexplained: str, magnitude: str, criticality: str, blame: str) -> Column:
    """What speaks for a service as a cause, as an array of sentences. Their wording is fixed."""
    c = F.col
    whole = lambda x: F.round(x * 100).cast("int")
    lines = F.array(
        F.when(c(error_rate) > 0, F.format_string("%d/%d calls errored (%.1f%%)", errors, calls, F.round(c(error_rate) * 100, 1))),
        F.concat(F.format_string("p95 %.0fms", p95), F.when(c(error_rate) == 0, "").otherwise(F.format_string(", avg %.0fms", avg))),
        F.when(c(unexplained) > 0.35, F.format_string("slow work not explained by child calls (self-time anomaly %d%%)", whole(c(unexplained)))),
        F.when(c(magnitude) > 0.4, F.format_string("latency %d%% above its own baseline", whole(c(magnitude)))),
        F.when(c(criticality) > 0.3, F.format_string("on critical path in %d%% of traces", whole(c(criticality)))),
        F.when(c(blame) > 0.4, F.format_string("implicated by %d%% of downstream impact", whole(c(blame)))),
    )
    return F.array_compact(lines)


def symptom(signal: str, calls: str, errors: str, error_rate: str, p95: str, magnitude: str) -> Column:
    """What is seen of a service, by its first signal. The wording is fixed."""
    share = F.round(F.col(magnitude) * 100).cast("int")
    return (
        F.when(F.col(error_rate) > 0, F.format_string("error rate %.1f%% (%d/%d calls)", F.round(F.col(error_rate) * 100, 1), errors, calls))
        .when(F.col(signal) == "latency", F.format_string("latency up to %.0fms (%d%% above baseline)", p95, share))
        .otherwise(F.format_string("throughput pressure / queue backlog (%d%% of normal load)", share))
    )


#: Advice by words that error messages contain.
ADVICE = (
    (("timeout", "timed out"), "Raise client/server timeout bounds and re-check the dependency SLO for the slowest callee."),
    (("pool",), "Connection/thread pool exhaustion detected — increase pool size or add wait-queue limits on the top-ranked service."),
    (("queue", "backlog"), "Downstream queue backlog — add backpressure, rate limiting, or increase consumer concurrency."),
    (("connection refused", "connect econnrefused"), "A callee refused connections — verify the target service is up, healthy, and has free slots."),
    (("ec2 ",), "ECONN reset during a call — check for proxy/load-balancer timeouts or dropped keep-alive connections."),
)

#: Fixed value: what is said where nothing else is.
NO_ADVICE = "No obvious systemic fault — compare top-ranked services against their latency baselines and check for saturation."


def advice(message: Column) -> Column:
    """The pieces of advice that an error message calls for."""
    low = F.lower(message)
    return F.array_compact(F.array(*(F.when(F.greatest(*(low.contains(w) for w in words), F.lit(False)), text) for words, text in ADVICE)))
