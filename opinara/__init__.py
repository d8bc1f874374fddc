"""Opinara: customer-review sentiment analytics written as plain Spark jobs."""
