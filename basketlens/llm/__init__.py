"""Operators of a training-data pipeline over a corpus of documents and pages.

Each module holds one operator with its own interface; ``queries`` binds them
to the tables.  Nothing outside this subpackage imports it.
"""
