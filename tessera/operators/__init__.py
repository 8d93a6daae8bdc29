"""Operators over annotation DataFrames."""
