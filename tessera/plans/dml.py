"""Changes of data as DataFrame rewrites, and sequences.

Parquet files can't be changed in place: each function returns the table as it is afterwards, to be written over it or under
another name in one commit.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.predicates import lit
from tessera.operators.numbering import with_index
from tessera.sources.meta import CONSTRAINTS, constraints_of
from tessera.sources.table import Col, Mapped, Table


def insert(table: DataFrame, rows: DataFrame, *, defaults: dict[str, Any] | None = None) -> DataFrame:
    """``table`` with the rows added; columns that they lack take their default, or NULL."""
    given = {c: F.col(f"`{c}`") for c in rows.columns}
    unknown = set(given) - set(table.columns)
    if unknown:
        raise ValueError(f"the table has no column {', '.join(sorted(unknown))}")
    made = [(given[f.name] if f.name in given else lit((defaults or {}).get(f.name))).cast(f.dataType).alias(f.name) for f in table.schema]
    return table.unionAll(rows.select(*made))


def insert_values(table: DataFrame, rows: list[tuple], columns: list[str] | None = None, defaults: dict[str, Any] | None = None) -> DataFrame:
    names = columns or table.columns
    schema = T.StructType([T.StructField(n, table.schema[n].dataType) for n in names])
    return insert(table, table.sparkSession.createDataFrame(rows, schema), defaults=defaults)


def insert_returning(table: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(the table afterwards, the inserted rows with their new keys): keys go on from the largest one."""
    top = table.agg(F.coalesce(F.max(key), F.lit(0)).cast("long")).first()[0]
    numbered = with_index(rows.drop(key), [], "__n").withColumn(key, (F.lit(top + 1) + F.col("__n")).cast(table.schema[key].dataType)).drop("__n")
    return insert(table, numbered), numbered.select(*(c for c in table.columns if c in numbered.columns))


def insert_into(kind: type[Table], table: DataFrame, rows: DataFrame, *, force: bool = False, returning: list[str] | None = None) -> DataFrame | tuple[DataFrame, DataFrame]:
    """``table`` with the rows added as the declaration of ``kind`` says, and with ``returning`` those columns of the new rows.

    Values given for auto-increment columns are skipped, and these columns go on from the largest number there is; ``force``
    takes given values as they are.  Columns that aren't given get their default, or NULL.  Two writers that start from
    the same table give the same numbers: the commit of the second one has to fail or be repeated.
    """
    auto = [n for n, c in kind.cols().items() if c.auto_inc]
    defaults = {n: c.type.encode(c.default) if isinstance(c.type, Mapped) else c.default for n, c in kind.cols().items() if c.default is not None}
    new = rows if force else rows.drop(*auto)
    for key in auto:
        if key not in new.columns:
            top = table.agg(F.coalesce(F.max(key), F.lit(0)).cast("long")).first()[0]
            new = with_index(new, [], "__n").withColumn(key, (F.lit(top + 1) + F.col("__n")).cast(table.schema[key].dataType)).drop("__n")
    after = insert(table, new, defaults=defaults)
    if returning is None:
        return after
    whole = insert(table.limit(0), new, defaults=defaults)
    return after, whole.select(*returning)


def update(table: DataFrame, where: Column, values: dict[str, Any]) -> DataFrame:
    """Rows for which ``where`` is TRUE get the values."""
    hit = F.coalesce(where, F.lit(False))
    return table.select(*(F.when(hit, lit(values[f.name]).cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in values else F.col(f"`{f.name}`") for f in table.schema))


def delete(table: DataFrame, where: Column) -> DataFrame:
    """Without the rows for which ``where`` is TRUE; those for which it is NULL stay."""
    return table.where(~F.coalesce(where, F.lit(False)))


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows with a known key replace it, others are added.  The keys of ``rows`` are distinct."""
    kept = table.join(rows.select(*key), key, "left_anti").select(*table.columns)
    return insert(kept, rows)


def affected(table: DataFrame, where: Column) -> int:
    """How many rows an update or delete with this condition changes."""
    return table.where(where).count()


@dataclass
class Sequence:
    """Numbers by a rule; ``next`` counts on in the client, ``column`` gives the rows of a query their numbers."""

    name: str
    start: int | None = None
    inc: int = 1
    min: int | None = None
    max: int | None = None
    cycle: bool = False
    _at: int | None = field(default=None, repr=False)

    def __post_init__(self):
        if self.inc == 0:
            raise ValueError("a sequence has to move")
        up = self.inc > 0
        self.min = self.min if self.min is not None else (1 if up else -(1 << 63))
        self.max = self.max if self.max is not None else ((1 << 63) - 1 if up else -1)
        if self.start is None:
            self.start = self.min if up else self.max
        if not self.min <= self.start <= self.max:
            raise ValueError("the start is outside the bounds")

    def next(self) -> int:
        if self._at is None:
            self._at = self.start
        else:
            n = self._at + self.inc
            if not self.min <= n <= self.max:
                if not self.cycle:
                    raise OverflowError(f"the sequence {self.name} is at its end")
                n = self.min if self.inc > 0 else self.max
            self._at = n
        return self._at

    def curr(self) -> int:
        if self._at is None:
            raise LookupError(f"the sequence {self.name} has no value yet")
        return self._at

    def column(self, df: DataFrame, name: str, order: list[Column] | None = None) -> DataFrame:
        """``df`` numbered from the sequence's start, cycling if it does."""
        n = F.col("__n")
        if self.cycle:
            first = (self.max - self.start) // self.inc + 1 if self.inc > 0 else (self.start - self.min) // -self.inc + 1
            round_ = (self.max - self.min) // abs(self.inc) + 1
            again = F.lit(self.min if self.inc > 0 else self.max) + F.pmod(n - first, F.lit(round_)) * self.inc
            value = F.when(n < first, F.lit(self.start) + n * self.inc).otherwise(again)
        else:
            value = F.lit(self.start) + n * self.inc
            last = (self.max - self.start) // self.inc if self.inc > 0 else (self.start - self.min) // -self.inc
            value = F.when(n > last, F.raise_error(F.lit(f"the sequence {self.name} is at its end"))).otherwise(value)
        return with_index(df, order or [], "__n").withColumn(name, value.cast("long")).drop("__n")


def create_statements(*tables: type[Table], if_not_exists: bool = False, using: str = "parquet") -> list[str]:
    """CREATE TABLE statements with lengths and defaults; keys and indexes are properties of the table (``meta.constraints``)."""
    out = []
    for t in tables:
        cols = ", ".join(f"`{n}` {_sql_type(c)}{'' if c.nullable else ' NOT NULL'}{_sql_default(c)}" for n, c in t.cols().items())
        held = json.dumps(constraints_of(t)).replace("\\", "\\\\").replace("'", "\\'")
        out.append(f"CREATE TABLE {'IF NOT EXISTS ' if if_not_exists else ''}`{t.name}` ({cols}) USING {using} TBLPROPERTIES ('{CONSTRAINTS}' = '{held}')")
    return out


def _sql_type(c: Col) -> str:
    kind = c.spark_type.simpleString()
    return f"varchar({c.length})" if c.length and kind == "string" else kind


def _sql_default(c: Col) -> str:
    if c.default is None:
        return ""
    value = c.type.encode(c.default) if isinstance(c.type, Mapped) else c.default
    if isinstance(value, str):
        value = "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    elif isinstance(value, bool):
        value = str(value).lower()
    return f" DEFAULT CAST({value} AS {c.spark_type.simpleString()})"


def drop_statements(*tables: type[Table], if_exists: bool = False) -> list[str]:
    return [f"DROP TABLE {'IF EXISTS ' if if_exists else ''}`{t.name}`" for t in reversed(tables)]


def truncate_statements(*tables: type[Table]) -> list[str]:
    return [f"TRUNCATE TABLE `{t.name}`" for t in tables]
