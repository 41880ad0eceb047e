"""Functions and operators of the SQL engine by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.predicates import lit


def function(name: str) -> Callable[..., Column]:
    """A function with any number of arguments (none, one, two, ...)."""
    return lambda *args: F.call_function(name, *map(lit, args))


_OPERATORS = {
    "+": Column.__add__,
    "-": Column.__sub__,
    "*": Column.__mul__,
    "/": Column.__truediv__,
    "%": Column.__mod__,
    "=": Column.__eq__,
    "<": Column.__lt__,
    "<=": Column.__le__,
    ">": Column.__gt__,
    ">=": Column.__ge__,
    "and": Column.__and__,
    "or": Column.__or__,
    "&": Column.bitwiseAND,
    "|": Column.bitwiseOR,
    "^": Column.bitwiseXOR,
    "==": Column.__eq__,
    "<>": Column.__ne__,
    "!=": Column.__ne__,
    "<=>": Column.eqNullSafe,
    "||": F.concat,
    "like": lambda a, b: F.call_function("like", a, b),
    "ilike": lambda a, b: F.call_function("ilike", a, b),
    "rlike": F.rlike,
    "is distinct from": lambda a, b: ~a.eqNullSafe(b),
    "is not distinct from": Column.eqNullSafe,
}


def operator(symbol: str) -> Callable[..., Column]:
    """An infix operator; ``div``, ``mod`` and others that are words are called as functions of two arguments.

    Any other symbol is put between its operands as SQL text; whether there is such an operator the engine says.
    """
    known = _OPERATORS.get(symbol.lower())
    if known is None and not symbol.isidentifier():
        return expression("({0}) " + symbol.replace("{", "{{").replace("}", "}}") + " ({1})")
    return lambda a, b: known(lit(a), lit(b)) if known else F.call_function(symbol, lit(a), lit(b))


def literal(token: str) -> Column:
    """A token of SQL as it stands."""
    return F.expr(token)


def expression(template: str) -> Callable[..., Column]:
    """SQL with ``{0}``, ``{1}``, ... for its arguments, as ``expression("extract(year from {0})")("o_orderdate")``.

    An argument is a column's name or any expression.
    """

    def made(*args: str | Column) -> Column:
        if all(isinstance(a, str) for a in args):
            return F.expr(template.format(*(f"`{n}`" for n in args)))
        # the arguments become fields of a value that the text sees as the variable of a lambda
        fields = F.struct(*((F.col(f"`{a}`") if isinstance(a, str) else lit(a)).alias(f"a{i}") for i, a in enumerate(args)))
        text = template.format(*(f"__x.a{i}" for i in range(len(args))))
        return F.call_function("transform", F.array(fields), F.expr(f"__x -> {text}")).getItem(0)

    return made
