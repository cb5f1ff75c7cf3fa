"""Operators of a training-data pipeline over a table of documents or vectors.

Nothing else in the library imports this subpackage.
"""
