"""Event-log plans."""
