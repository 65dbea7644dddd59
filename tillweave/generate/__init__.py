"""Deterministic synthetic retail data at any scale."""
