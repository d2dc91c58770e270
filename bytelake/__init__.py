"""Batch jobs over large collections of byte strings, as functions from DataFrames to DataFrames."""
