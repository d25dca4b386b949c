"""Column-level building blocks (pure ``pyspark.sql.Column`` expressions)."""
