"""Table operators: they take and return DataFrames."""
