"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  ``catalog`` lists its queries and their SQL.
"""
