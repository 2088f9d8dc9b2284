"""Operators of a training-data pipeline over text, vectors and conversations.

Nothing else in the library imports this package. Each module holds one operator
with its own interface; ``catalog`` derives the registered queries from them.
"""
