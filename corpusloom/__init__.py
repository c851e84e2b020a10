"""Code-intelligence and corpus analytics on PySpark."""
