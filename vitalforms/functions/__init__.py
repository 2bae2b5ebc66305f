"""Column-level functions: they take and return Spark Columns."""
