"""Community-abundance analytics as Spark DataFrame operations."""
