"""Operational time-series analytics on Spark: query language, render walk, extraction, storage."""
