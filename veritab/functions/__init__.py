"""Column functions: each takes and gives Spark columns, so that they stay inside generated code."""
