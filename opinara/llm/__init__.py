"""Operators for preparing training text: filtering, deduplication, decontamination, formatting, packing."""
