"""Operators of a training-data pipeline: one module per operator.

Nothing else in the library imports this subpackage.  The thin contract queries live in
``queries.py`` and their DuckDB statements in ``oracles.py``.
"""
