"""Event-log functions."""
