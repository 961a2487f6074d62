"""Relational operators over the asset relations: DataFrames in, DataFrames out, no actions."""
