"""Writers: binary traces, span exports, reports."""
