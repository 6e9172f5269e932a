"""Operators for preparing text corpora at scale, and their queries.

Nothing else in the library imports this subpackage.
"""
