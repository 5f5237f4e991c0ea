"""Operators for training-data pipelines over text, conversations and media.

Nothing outside this package imports it.  ``queries`` registers the queries.
"""
