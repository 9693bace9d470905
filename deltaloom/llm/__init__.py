"""Operators for preparing training text, separate from the table-synchronisation engine.

Nothing outside this subpackage imports it. ``queries`` lists the registered queries and
``sql`` their DuckDB counterparts.
"""
