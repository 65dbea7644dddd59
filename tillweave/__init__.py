"""Retail analytics and dataset reconciliation, written as Spark jobs."""
