"""Training-data operators: deduplication, decontamination, extraction, scans, mixing, output, language ID.

Nothing outside this subpackage imports it. ``registry`` holds the queries and their SQL.
"""
