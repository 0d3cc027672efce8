"""Time-partitioned tables on Spark: routing, pruning, retention, metadata counts and vector search."""
