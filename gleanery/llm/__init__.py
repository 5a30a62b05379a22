"""Operators of a training-data pipeline: each takes and returns DataFrames.

Nothing outside this subpackage imports it.
"""
