"""Canonical text of JSON values: equal for contexts that differ only in key order or rounding."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Context keys that differ from run to run and take no part in a fingerprint.
RUN_KEYS = (
    "timestamp", "time", "now", "hrtime", "monotonicTime", "requestId", "request.id", "traceId", "trace.id",
    "spanId", "span.id", "sessionId", "correlationId",
)
#: Decimals that numbers are rounded to, and the depth below which a value is "[deep]".
DECIMALS, DEPTH = 4, 8


def number(x: float) -> str:
    """A number rounded half up, as a script prints it."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    rounded = math.floor(x * 10**DECIMALS + 0.5) / 10**DECIMALS
    return str(int(rounded)) if rounded == int(rounded) and abs(rounded) < 1e21 else repr(rounded)


def canonical(value, depth: int = 0) -> str:
    """Typed text of a parsed JSON value; objects by sorted keys."""
    if depth > DEPTH:
        return "[deep]"
    if value is None:
        return "null"
    if isinstance(value, bool):
        return f"boolean:{str(value).lower()}"
    if isinstance(value, str):
        return f"string:{json.dumps(value, ensure_ascii=False)}"
    if isinstance(value, int | float):
        return f"number:{number(float(value))}"
    if isinstance(value, list):
        return f"array:[{','.join(canonical(v, depth + 1) for v in value)}]"
    return "object:{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k], depth + 1)}" for k in sorted(value)) + "}"


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def canonical_map(contexts: pd.Series) -> pd.Series:
    """Keys of a JSON object with the canonical text of their values; an empty map for anything else."""

    def one(text):
        try:
            found = json.loads(text) if text else {}
        except ValueError:
            return {}
        return {k: canonical(v) for k, v in found.items()} if isinstance(found, dict) else {}

    return contexts.map(one)


def context_text(entries: str, ignore: tuple[str, ...] = RUN_KEYS):
    """Canonical text of a map of canonical_map: sorted keys, without ignored ones and nulls."""
    kept = F.filter(F.array_sort(F.map_entries(entries)), lambda e: ~e["key"].isin(*ignore) & (e["value"] != "null"))
    pieces = F.transform(kept, lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(pieces, ","), F.lit("}"))
