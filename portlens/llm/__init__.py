"""Operators for training-data pipelines over `documents` and `embeddings`.

Nothing outside this package imports it; `__spark_entry__.py` adds its
queries only where the package is present.
"""
