"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; the queries that show it at work are in
``queries.py`` and are added to the registry by ``__spark_entry__.py`` alone.
"""
