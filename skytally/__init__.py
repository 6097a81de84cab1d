"""Observation and market analytics on Spark DataFrames and Structured Streaming."""
