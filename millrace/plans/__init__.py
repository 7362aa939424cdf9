"""Compound queries: work graph, scheduling, reports."""
