"""Training-data operators: tokenising, privacy, mixing, deduplication, scoring, sharding, extraction.

Nothing outside this folder imports it; the entry module adds its queries when it is present.
"""
