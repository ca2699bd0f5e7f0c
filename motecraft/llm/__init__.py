"""Operators for preparing training text: filters, deduplication, privacy and mixing, each run as Spark jobs."""
