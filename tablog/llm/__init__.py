"""Operators for preparing language-model training data.

Nothing outside this package imports it.  Every operator takes DataFrames and
column names and returns a DataFrame; ``queries.py`` holds the registered
queries, which read whole tables.
"""
