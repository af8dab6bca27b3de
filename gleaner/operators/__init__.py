"""Search, lookup and derivation operators: DataFrames in, DataFrames out."""
