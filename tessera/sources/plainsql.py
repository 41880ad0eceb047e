"""Plain SQL: bound values are parameters, spliced parts are text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.operators.query import Query


def sql(spark: SparkSession, text: str, /, *, splice: dict[str, str] | None = None, views: dict[str, DataFrame] | None = None, **binds: Any) -> Query:
    """``text`` with ``:name`` for bound values and ``{name}`` for spliced text; ``views`` are tables by name."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    for name, part in (splice or {}).items():
        text = text.replace("{" + name + "}", part)
    binds = {k: bind(v) for k, v in binds.items()}
    return Query.of(spark.sql(text, args=binds) if binds else spark.sql(text))


def sqlu(spark: SparkSession, text: str, /, **binds: Any) -> int:
    """A statement; how many rows it affected as far as the table's format tells, else 0."""
    binds = {k: bind(v) for k, v in binds.items()}
    rows = (spark.sql(text, args=binds) if binds else spark.sql(text)).collect()
    return int(rows[0]["num_affected_rows"]) if rows and "num_affected_rows" in rows[0].asDict() else 0


_SETTERS: dict[type, Callable[[Any], Any]] = {}


def set_parameter(kind: type, to_value: Callable[[Any], Any]) -> None:
    """From now on bound values of ``kind`` (and its subclasses) are what ``to_value`` gives: a value or a Column."""
    _SETTERS[kind] = to_value


def bind(value: Any) -> Any:
    """What is bound for a value: the nearest class with a setter decides, lists and tuples become arrays."""
    setter = next((_SETTERS[kind] for kind in type(value).__mro__ if kind in _SETTERS), None)
    if setter:
        value = setter(value)
    if isinstance(value, (list, tuple)):
        return F.array(*(F.lit(v) for v in value))
    return value


class Reader:
    """Reads a row column by column."""

    def __init__(self, row: Row):
        self._values: Iterator[Any] = iter(row)

    def next(self) -> Any:
        return next(self._values)

    __lshift__ = next


def as_(query: Query, make: Callable[[Reader], Any]) -> list[Any]:
    """The result with ``make`` applied to each row on the client."""
    return [make(Reader(r)) for r in query.result()]
