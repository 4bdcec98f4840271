"""Operators of a training-data pipeline, one module per operator.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
and returns a DataFrame; ``queries.py`` registers a query per operator.
"""
