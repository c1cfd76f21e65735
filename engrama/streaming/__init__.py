"""Structured Streaming forms of the event observer and the op-log."""
