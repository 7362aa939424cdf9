"""Readers with declared schemas, and plain sinks."""
