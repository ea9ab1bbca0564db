"""Training-data operators: deduplication, filtering, scanning and mixing of documents.

Nothing outside this subpackage imports it.
"""
