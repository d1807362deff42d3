"""Type-graph and corpus analytics on PySpark."""
