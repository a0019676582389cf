"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Each ``opN`` module holds one
operator with a general interface, and the thin query that applies it to a
whole table.
"""
