"""Operators of a training-data pipeline over ``documents`` and ``embeddings``.

Each module holds one operator with its own general interface; ``queries.py``
registers them.  Nothing outside this subpackage imports it.
"""
