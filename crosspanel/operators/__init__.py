"""Operators on long panels: DataFrames in, lazy DataFrames out."""
