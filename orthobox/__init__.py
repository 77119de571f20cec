"""A PySpark engine for multi-attribute points: box queries, lookups and membership over Morton-clustered Parquet."""
