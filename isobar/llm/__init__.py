"""Operators for building training corpora out of large document tables.

Nothing outside this subpackage imports it.  ``queries.QUERIES`` and
``queries.ORACLE_SQL`` hold what ``__spark_entry__`` registers.
"""
