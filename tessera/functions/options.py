"""Optional values: a nullable column, an optional row is a nullable struct, and an optional optional one struct<v>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.predicates import lit


def some(c) -> Column:
    return lit(c)


def none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def get(c: Column) -> Column:
    """The value; the query fails where there is none."""
    return F.when(c.isNull(), F.raise_error(F.lit("the value is not defined"))).otherwise(c)


def get_or_else(c: Column, default) -> Column:
    return F.coalesce(c, lit(default))


def fold(c: Column, if_empty, f: Callable[[Column], Column]) -> Column:
    return F.when(c.isNull(), lit(if_empty)).otherwise(f(c))


def map_option(c: Column, f: Callable[[Column], Column]) -> Column:
    return F.when(c.isNotNull(), f(c))


def flat_map_option(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` gives an optional value itself."""
    return F.when(c.isNotNull(), f(c))


def filter_option(c: Column, p: Callable[[Column], Column]) -> Column:
    """No value unless ``p`` holds."""
    return F.when(p(c), c)


def is_empty(c: Column) -> Column:
    return c.isNull()


def is_defined(c: Column) -> Column:
    return c.isNotNull()


def nest(c: Column) -> Column:
    """An optional value as the value of another option: {NULL} is Some(None)."""
    return F.struct(c.alias("v"))


def flatten(c: Column) -> Column:
    """Both None and Some(None) are None."""
    return c["v"]
