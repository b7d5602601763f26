"""Schemas of the trace model."""

from __future__ import annotations

#: One trace event; seq is its place in the input and breaks ties of ts_ms.
EVENT = "seq long, channel string, event_type string, ts_ms double, operation_id string, duration_ms double, context_json string, error_message string"
#: One distributed span.
SPAN = "trace_id string, span_id string, parent_span_id string, service string, name string, kind int, start_ms double, end_ms double, error boolean, error_message string"
EVENT_TYPES = ("start", "end", "asyncStart", "asyncEnd", "error")
SPAN_TYPES = ("start", "end", "error")
