"""Document knowledge analytics as PySpark DataFrame operators."""
