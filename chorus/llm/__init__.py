"""Operators of a training-data pipeline over documents, pages and embeddings.

Each module holds one operator with its own interface; ``queries`` registers the
``opN_`` queries and the ``pipeline`` query with their oracles.
"""
