"""factloom: evidence-grounded fact analytics as PySpark DataFrame jobs."""
