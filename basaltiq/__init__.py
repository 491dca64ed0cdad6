"""A relational analytics engine over Spark DataFrames."""
