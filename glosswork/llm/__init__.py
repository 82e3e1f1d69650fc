"""Operators of a large training-data pipeline; nothing outside this package imports it."""
