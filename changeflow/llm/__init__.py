"""Operators for preparing training data: cleaning, deduplication, scoring, packing and output.

Each module holds one operator as functions from DataFrames to a DataFrame; ``queries``
registers them over the standard tables. Rows are never changed in place: an operator reads the
columns it names and ignores any others, whatever they are called.
"""
