"""Event-log operators."""
