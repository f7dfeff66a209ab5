"""Building and running a query."""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphtables.errors import CypherError
from graphtables.operators.lower import lower
from graphtables.plans.binder import bind
from graphtables.plans.logical import Plan
from graphtables.plans.parser import parse
from graphtables.sources.graph import Graph


class QueryBuilder:
    """``graph.query(text).parameter("name", value).df()``.  No step runs a Spark job."""

    def __init__(self, graph: Graph, text: str):
        self.graph, self.text = graph, text
        self.parameters: dict[str, object] = {}

    def parameter(self, name: str, value: int | float | str | bool | None) -> QueryBuilder:
        if value is not None and not isinstance(value, int | float | str | bool):
            raise TypeError(f"parameter `{name}` must be an integer, a float, a string, a boolean or None")
        self.parameters[name] = value
        return self

    def plan(self) -> Plan:
        try:
            return bind(parse(self.text), self.graph, self.parameters)
        except CypherError as e:
            raise e.within(self.text) from None

    def df(self) -> DataFrame:
        """The lazy result; all errors of the query itself are raised here."""
        plan = self.plan()
        try:
            return lower(plan, self.graph, self.parameters)
        except CypherError as e:
            raise e.within(self.text) from None

    def explain(self) -> str:
        """The logical plan and Spark's plans."""
        plan = "\n".join(self.plan().lines()).replace("\0", "_")
        return f"logical plan:\n{plan}\n\nspark plans:\n{self.df()._jdf.queryExecution().toString()}"
