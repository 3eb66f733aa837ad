"""Training-data operators: tokenizing, mixing, scoring, deduplication, vector search, URL filters.

Nothing outside this subpackage imports it; ``registry`` holds its queries and their SQL.
"""
