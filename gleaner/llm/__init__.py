"""Operators of a training-data pipeline: ten numbered operators, their queries and SQL."""
