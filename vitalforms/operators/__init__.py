"""DataFrame-level operators: they take and return DataFrames."""
