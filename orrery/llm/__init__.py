"""Operators of a large-scale training-data pipeline.

Every operator takes a DataFrame, selects the columns that it names and ignores all others,
so extra columns of any name are harmless. Nothing else in the library imports this package.
"""
