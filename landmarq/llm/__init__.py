"""Operators for building training data out of large document tables.

Nothing else in the library imports this subpackage; ``queries`` lists its
registered queries and their SQL.
"""
