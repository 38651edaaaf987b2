"""Network-measurement analytics on PySpark."""
