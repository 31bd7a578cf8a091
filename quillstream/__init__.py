"""PySpark-native engine for bibliographic record streams.

Extract records from stored pages, clean and enrich them, load a message
stream idempotently, keep counters, and answer searches and rankings -- all as
DataFrame and Structured Streaming plans.
"""
