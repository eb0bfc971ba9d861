"""A Spark-native analytics engine: keyed tables, change logs and matching queries on DataFrames."""
