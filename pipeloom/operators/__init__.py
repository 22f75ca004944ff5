"""Compilation of bound stages to DataFrames."""
