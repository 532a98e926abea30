"""Operators for preparing training corpora, as Spark jobs over whole tables.

Nothing else in the library imports this subpackage.  `queries.py` holds the
registered queries and `sql.py` their DuckDB counterparts.
"""
