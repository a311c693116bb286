"""Event-log sources."""
