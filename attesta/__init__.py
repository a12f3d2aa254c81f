"""Receipt-backed analytics on PySpark."""
