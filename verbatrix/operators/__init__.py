"""Operators on DataFrames of blocks, tables, chunks, hits, answers and grades."""
