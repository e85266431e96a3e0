"""Set-oriented operators: DataFrames in, DataFrame out."""
