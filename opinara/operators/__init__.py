"""Operators: functions from DataFrame to DataFrame, and predicates over their columns."""
