"""Operators for large training-data corpora, each a DataFrame -> DataFrame function.

Nothing outside this subpackage imports it; ``queries`` lists its registered queries.
"""
