"""Registered queries of the trace operators and their DuckDB oracles, gathered from the modules here."""

from __future__ import annotations

from . import q_causal, q_core, q_differential, q_distributed, q_jit, q_memory, q_more, q_signals, q_sources, q_streaming

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (q_core, q_causal, q_distributed, q_memory, q_signals, q_differential, q_jit, q_more, q_streaming, q_sources):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
