"""Operators for preparing training data for language models.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; `queries` applies each to its whole intended table.
"""
