"""Column builders: they only compose built-in Spark functions."""
