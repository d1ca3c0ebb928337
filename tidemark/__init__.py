"""Tidemark: time-addressed evidence analytics on PySpark."""
