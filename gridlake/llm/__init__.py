"""Operators of a training-data pipeline over the ``documents`` and ``pages`` tables.

Nothing outside this subpackage imports it.  Every operator selects the columns it needs by
name, so extra columns (clashing names included) pass it by, and states what it does with nulls,
empty texts, ties and empty tables in its docstring.
"""
