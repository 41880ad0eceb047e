"""Comparisons, membership, patterns and conditionals.  NULL follows SQL's three-valued logic throughout."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def equal(a, b) -> Column:
    """Equality; tuples of columns are compared member by member."""
    if isinstance(a, tuple) and isinstance(b, tuple):
        return reduce(Column.__and__, (lit(x) == lit(y) for x, y in zip(a, b, strict=True)))
    return lit(a) == lit(b)


def not_equal(a, b) -> Column:
    return ~equal(a, b)


def between(c: Column, low, high) -> Column:
    """Inclusive on both sides."""
    return c.between(low, high)


def is_in(c: Column, *values) -> Column:
    """Membership among expressions."""
    return c.isin(*values) if values else F.lit(False)


def in_set(c: Column, values: Iterable) -> Column:
    """Membership in a collection of the client; an empty one is FALSE, also for NULL."""
    found = list(values)
    return c.isin(found) if found else F.lit(False)


def if_null(c: Column, other) -> Column:
    return F.coalesce(c, lit(other))


def like(c: Column, pattern: str, escape: str = "\\") -> Column:
    """SQL LIKE.  The escape character is one character and none of ``'``, ``%`` and ``_``."""
    if len(escape) != 1 or escape in "'%_":
        raise ValueError(f"{escape!r} can't be an escape character")
    return F.like(c, F.lit(pattern), F.lit(escape))


def starts_with(c: Column, prefix: str) -> Column:
    """A literal prefix: ``%`` and ``_`` stand for themselves."""
    return c.startswith(prefix)


def ends_with(c: Column, suffix: str) -> Column:
    return c.endswith(suffix)


class Case:
    """``Case.If(c).Then(x).If(d).Then(y).Else(z)``; without Else the result is NULL where nothing holds."""

    def __init__(self, branches: tuple = (), condition: Column | None = None):
        self._branches, self._condition = branches, condition

    @classmethod
    def If(cls, condition: Column) -> Case:  # noqa: N802
        return cls((), condition)

    def Then(self, value) -> _Branches:  # noqa: N802
        return _Branches((*self._branches, (self._condition, value)))


class _Branches:
    def __init__(self, branches: tuple):
        self._branches = branches

    def If(self, condition: Column) -> Case:  # noqa: N802
        return Case(self._branches, condition)

    @property
    def column(self) -> Column:
        (c, v), *rest = self._branches
        out = F.when(c, lit(v))
        for c, v in rest:
            out = out.when(c, lit(v))
        return out

    def Else(self, value) -> Column:  # noqa: N802
        return self.column.otherwise(lit(value))
