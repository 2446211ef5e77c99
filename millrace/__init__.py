"""Content and warehouse-metadata analytics on PySpark."""
