"""Training-data operators: tokenisation, scoring, deduplication, search, packing and archives.

Nothing outside this folder imports it. Each module holds one operator; ``queries`` registers them.
"""
