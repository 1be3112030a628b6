"""Column functions: text in, column out, all of Spark's built-in functions."""
