"""Comparing two copies of a dataset: canonical text, keyed compare, schema gates, verdicts."""
