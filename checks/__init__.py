"""Registered queries, the inputs Spark derives for them, and their SQL."""
