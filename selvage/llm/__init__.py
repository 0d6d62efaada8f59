"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator is a plain function
from DataFrames to a DataFrame; ``queries`` holds the thin registered queries.
"""
