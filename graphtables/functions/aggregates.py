"""Names of the aggregate functions, in lower case."""

AGGREGATES = ("count", "sum", "avg", "min", "max", "collect")
