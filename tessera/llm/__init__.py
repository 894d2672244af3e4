"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; queries and their SQL are in :mod:`tessera.llm.queries`.
"""
