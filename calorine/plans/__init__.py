"""Stage plans: DataFrames in, DataFrames out."""
