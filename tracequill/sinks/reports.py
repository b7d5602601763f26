"""Reports: findings as rows, rendered from small results."""

from __future__ import annotations

import base64
import html
import json
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def key_findings(stats: DataFrame, slow_ms: float = 100.0) -> DataFrame:
    """(channel, place, finding): slow channels, and channels with errors."""
    slow = F.when(F.col("avg_ms") > slow_ms, F.format_string('"%s" avg %.0fms, P95 %.0fms', "channel", F.col("avg_ms").cast("double"), F.col("p95_ms").cast("double")))
    rate = F.when(F.col("total") > 0, F.col("errors") / F.col("total") * 100).otherwise(0.0)
    failing = F.when(F.col("errors") > 0, F.format_string('"%s" has %d errors (%.1f%%)', "channel", "errors", F.round(rate, 1)))
    return stats.select("channel", F.posexplode(F.array(slow, failing)).alias("place", "finding")).filter("finding IS NOT NULL")


def heap_findings(total_bytes: int, leaks: int) -> list[str]:
    found = [f"Heap analysis found {leaks} potential leak(s)"] if leaks else []
    return [*found, f"Heap total: {total_bytes / 1024 / 1024:.1f}MB"]


def report(summary: DataFrame, stats: DataFrame, heap: tuple[int, int] | None = None) -> dict:
    """A versioned report as a plain document. summary: one row; stats: a row per channel (a small result)."""
    s = summary.first()
    found = [r.finding for r in key_findings(stats).orderBy("channel", "place").collect()]
    found += heap_findings(*heap) if heap else []
    return {
        "version": 1,
        "eventSummary": {"channels": [r.asDict() for r in stats.orderBy("channel").collect()], "totalEvents": s["total_events"], "totalOperations": s["total_operations"], "errorRate": s["error_rate"]},
        "keyFindings": found or ["No significant findings"],
    }


def to_text(document: dict) -> str:
    """A report small enough for a link: compressed, in the letters of a URL."""
    return base64.urlsafe_b64encode(zlib.compress(json.dumps(document, default=str).encode(), 9)).decode().rstrip("=")


def from_text(text: str) -> dict:
    return json.loads(zlib.decompress(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))))


@F.pandas_udf(T.StringType())
def squeeze(documents: pd.Series) -> pd.Series:
    """to_text over a column of JSON texts."""
    return documents.map(lambda t: None if t is None else to_text(json.loads(t)))


@F.pandas_udf(T.StringType())
def unsqueeze(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else json.dumps(from_text(t), separators=(",", ":")))


def to_markdown(document: dict) -> str:
    """A report as Markdown: summary, findings, a table of channels."""
    s = document["eventSummary"]
    lines = ["# Trace report", "", f"* Events: {s['totalEvents']}", f"* Operations: {s['totalOperations']}", f"* Error rate: {s['errorRate'] * 100:.1f}%", "", "## Findings", ""]
    lines += [f"* {x}" for x in document["keyFindings"]] + ["", "## Channels", ""]
    if s["channels"]:
        names = list(s["channels"][0])
        lines += ["| " + " | ".join(names) + " |", "|" + " - |" * len(names)]
        lines += ["| " + " | ".join(str(c[n]) for n in names) + " |" for c in s["channels"]]
    return "\n".join(lines) + "\n"


def to_html(document: dict) -> str:
    """A report as a page of its own."""
    s = document["eventSummary"]
    names = list(s["channels"][0]) if s["channels"] else []
    cell = lambda tag, x: f"<{tag}>{html.escape(str(x))}</{tag}>"
    head = "<tr>" + "".join(cell("th", n) for n in names) + "</tr>"
    body = "".join("<tr>" + "".join(cell("td", c[n]) for n in names) + "</tr>" for c in s["channels"])
    found = "".join(cell("li", x) for x in document["keyFindings"])
    return f"<!doctype html><meta charset=utf-8><title>Trace report</title><h1>Trace report</h1><p>{s['totalEvents']} events, {s['totalOperations']} operations, error rate {s['errorRate'] * 100:.1f}%</p><h2>Findings</h2><ul>{found}</ul><h2>Channels</h2><table>{head}{body}</table>"


def gate_markdown(rules: list[dict]) -> str:
    """The gate's rows (rule, status, actual, threshold) as Markdown."""
    failed = any(r["status"] == "fail" for r in rules)
    lines = [f"# Performance gate: {'failed' if failed else 'passed'}", "", "| Rule | Status | Actual | Threshold |", "| - | - | - | - |"]
    return "\n".join(lines + [f"| {r['rule']} | {r['status']} | {r['actual']:g} | {r['threshold']:g} |" for r in rules]) + "\n"
