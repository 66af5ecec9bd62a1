"""Field reducers: what an event does to one field, as an aggregate, as a fold step, and in Python.

Each reducer has three forms. `aggregate` folds all events of a key at once, `step` is one
step of the `aggregate` higher-order function, `python` is one step on dictionaries; all
three give equal results, which the tests hold against each other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reducer:
    """Base; `source` is an expression over the event's columns."""

    source: str = "NULL"
    python_source: Callable[[dict], object] | None = None

    def value(self, event: dict) -> object:
        if self.python_source:
            return self.python_source(event)
        return event[self.source]


class Set(Reducer):
    """The field takes the event's value, null included."""


class Const(Reducer):
    """The field takes a constant."""


class Add(Reducer):
    """The event's value is added; a null adds nothing. The field starts at zero."""


class Count(Reducer):
    """One is added."""


class Append(Reducer):
    """The event's struct is appended to an array, in event order."""


def constant(value: object) -> Const:
    text = "NULL" if value is None else repr(value) if not isinstance(value, bool) else str(value).lower()
    return Const(text, lambda _: value)


def count() -> Count:
    return Count("1", lambda _: 1)


SETTERS, SUMS = (Set, Const), (Add, Count)


def kind_of(reducers: list[Reducer]) -> str:
    """`set`, `sum` or `append` if the reducers of a field commute as one aggregate, else `mixed`."""
    kinds = {"set" if isinstance(r, SETTERS) else "sum" if isinstance(r, SUMS) else "append" for r in reducers}
    return kinds.pop() if len(kinds) == 1 else "mixed"


def aggregate(by_type: dict[str, Reducer], type_col: Column, order: Column, spark_type: str, prefix: str = "") -> Column:
    """All events of a key as one aggregate expression."""
    kind = kind_of(list(by_type.values()))
    source = lambda r: F.expr(r.source).cast(spark_type)
    is_one = type_col.isin(*by_type)
    if kind == "set":
        value = F.lit(None).cast(spark_type)
        for name, r in by_type.items():
            value = F.when(type_col == name, source(r)).otherwise(value)
        return F.max_by(F.struct(value.alias("v")), F.when(is_one, order))["v"]
    if kind == "sum":
        value = F.lit(0).cast(spark_type)
        for name, r in by_type.items():
            value = F.when(type_col == name, F.coalesce(source(r), F.lit(0).cast(spark_type))).otherwise(value)
        return F.sum(value).cast(spark_type)
    if kind == "append":
        value = F.lit(None)
        for name, r in by_type.items():
            value = F.when(type_col == name, F.expr(r.source)).otherwise(value)
        listed = F.array_sort(F.collect_list(F.when(is_one, F.struct(order.alias("o"), value.alias("v")))))
        return F.transform(listed, lambda x: x["v"]).cast(spark_type)
    raise ValueError("a field that events both set and add to needs an ordered fold")


def start(reducers: list[Reducer], spark_type: str) -> Column:
    """Value of a field before its first event."""
    if any(isinstance(r, SUMS) for r in reducers):
        return F.lit(0).cast(spark_type)
    if any(isinstance(r, Append) for r in reducers):
        return F.array().cast(spark_type)
    return F.lit(None).cast(spark_type)
