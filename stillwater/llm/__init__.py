"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage; it can be removed as a
whole.  Every operator takes DataFrames and returns DataFrames; the queries in
``queries.py`` are thin wrappers over them.
"""
