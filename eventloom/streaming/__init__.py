"""Event-log streaming."""
