"""Types, expressions and functions of the query language as Spark columns."""
