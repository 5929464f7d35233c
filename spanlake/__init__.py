"""spanlake: evidence-grade document analytics on PySpark."""
