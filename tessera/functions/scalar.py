"""Scalar functions whose edge cases are fixed: 0-based strings, numbers that keep their type, SQL's NULL rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.predicates import lit


def divide(a: Column, b, kind: str = "double") -> Column:
    """``a / b`` in the operands' type: whole-number division that truncates for integer kinds (int, bigint, ...)."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.call_function("div", a, lit(b)).cast(kind)
    return a / lit(b)


def modulo(a: Column, b) -> Column:
    """The remainder has the sign of ``a``."""
    return a % lit(b)


def ceil(c: Column, kind: str = "double") -> Column:
    """Rounded up, in the operand's type."""
    return F.ceil(c).cast(kind)


def floor(c: Column, kind: str = "double") -> Column:
    """Rounded down, in the operand's type."""
    return F.floor(c).cast(kind)


def sign(c: Column) -> Column:
    """-1, 0 or 1 as an int."""
    return F.signum(c).cast("int")


def absolute(c: Column) -> Column:
    return F.abs(c)


def to_degrees(c: Column) -> Column:
    return F.degrees(c)


def to_radians(c: Column) -> Column:
    return F.radians(c)


def pi() -> Column:
    return F.pi()


def length(c: Column) -> Column:
    """Characters, as an int."""
    return F.length(c)


def concat(*cs: Column) -> Column:
    """NULL if any part is."""
    return F.concat(*cs)


def upper(c: Column) -> Column:
    return F.upper(c)


def lower(c: Column) -> Column:
    return F.lower(c)


def ltrim(c: Column) -> Column:
    """Without blanks (no other white space) on the left."""
    return F.ltrim(c)


def rtrim(c: Column) -> Column:
    return F.rtrim(c)


def trim(c: Column) -> Column:
    return F.trim(c)


def replace(c: Column, search: str, by: str) -> Column:
    return F.replace(c, F.lit(search), F.lit(by))


def reverse(c: Column) -> Column:
    return F.reverse(c)


def repeat(c: Column, n: int) -> Column:
    return F.repeat(c, n)


def substring(c: Column, start: int, end: int | None = None) -> Column:
    """From the 0-based ``start`` up to ``end``, which is excluded; beyond the string it is cut off."""
    if end is None:
        return F.substring(c, F.lit(start + 1), F.length(c))
    return F.substring(c, start + 1, max(0, end - start))


def take(c: Column, n: int) -> Column:
    return substring(c, 0, n)


def drop(c: Column, n: int) -> Column:
    return substring(c, n)


def index_of(c: Column, part: str) -> Column:
    """0-based place of the first occurrence, -1 if there is none."""
    return F.instr(c, F.lit(part)) - 1


def cast(c: Column, kind: str) -> Column:
    """As another type; text that isn't a value of that type is an error."""
    return c.cast(kind)


def user() -> Column:
    return F.current_user()


def database() -> Column:
    return F.current_database()


def current_date() -> Column:
    return F.current_date()


def current_time() -> Column:
    """Microseconds of the day, in the session's time zone."""
    now = F.current_timestamp()
    return (F.hour(now) * 3600 + F.minute(now) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), now) * 1_000_000).cast("long")
