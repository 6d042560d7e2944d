"""Operators for preparing text and vectors that train language models.

Nothing else in the library imports this subpackage; its queries are in ``queries``.
"""
