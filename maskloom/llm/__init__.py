"""Operators of a training-data pipeline over documents, vectors and conversations.

Nothing else in the library imports this subpackage. Every operator takes and returns DataFrames.
"""
