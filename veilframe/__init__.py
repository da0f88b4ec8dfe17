"""Privacy sanitisation of tables and preparation of training text, on PySpark."""
