"""Column functions on text, paths, URLs, sets, and payloads."""
