"""Operators over a corpus of scripts and a catalog of declarations: DataFrames in, DataFrames out."""
