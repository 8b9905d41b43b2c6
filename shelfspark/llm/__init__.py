"""Operators for building training corpora, with their queries.

Nothing else in the library imports this subpackage.
"""
