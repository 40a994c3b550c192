"""Operators for building language-model training corpora.

Nothing outside this package imports it, so it can be removed without touching
the rest of the library.
"""
