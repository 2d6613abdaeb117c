"""Operators for building training data from text.

Nothing outside this subpackage imports it; the rest of the library works without it.
"""
