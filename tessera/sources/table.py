"""Declared tables: physical columns, constraints, a default projection, and where the rows come from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.query import Query, Ref, selection


@dataclass(frozen=True)
class Mapped:
    """A type of the client that is stored as another one: both ways are functions of a value that isn't None."""

    base: str | T.DataType
    to_base: Callable[[Any], Any]
    from_base: Callable[[Any], Any]

    def encode(self, value: Any) -> Any:
        return None if value is None else self.to_base(value)

    def decode(self, value: Any) -> Any:
        return None if value is None else self.from_base(value)

    def lit(self, value: Any) -> Column:
        """A value of the type in a query."""
        return F.lit(self.encode(value)).cast(_type(self.base))


def _type(kind: str | T.DataType | Mapped) -> T.DataType:
    if isinstance(kind, Mapped):
        kind = kind.base
    return kind if isinstance(kind, T.DataType) else T._parse_datatype_string(kind)


@dataclass(frozen=True)
class Col:
    """A physical column and its options.  ``length`` bounds a string, ``default`` is what an insert without a value gets."""

    type: str | T.DataType | Mapped
    nullable: bool = False
    primary_key: bool = False
    auto_inc: bool = False
    unique: bool = False
    default: Any = None
    length: int | None = None

    @property
    def spark_type(self) -> T.DataType:
        return _type(self.type)


@dataclass(frozen=True)
class ForeignKey:
    """A foreign key; it is followed with ``Table.follow``, and constrains nothing by itself."""

    columns: tuple[str, ...]
    target: str
    target_columns: tuple[str, ...]
    on_update: str = "no action"
    on_delete: str = "no action"


@dataclass(frozen=True)
class Index:
    columns: tuple[str, ...]
    unique: bool = False


class Table:
    """Subclass it with ``Col`` attributes; ``star`` is the default projection and may compute or leave out columns."""

    name: ClassVar[str] = ""
    foreign_keys: ClassVar[dict[str, ForeignKey]] = {}
    indexes: ClassVar[dict[str, Index]] = {}

    @classmethod
    def cols(cls) -> dict[str, Col]:
        return {n: c for k in reversed(cls.__mro__) for n, c in vars(k).items() if isinstance(c, Col)}

    @classmethod
    def schema(cls) -> T.StructType:
        """The physical columns."""
        return T.StructType([T.StructField(n, c.spark_type, c.nullable or c.default is not None, {"primary_key": c.primary_key, "auto_inc": c.auto_inc}) for n, c in cls.cols().items()])

    @classmethod
    def primary_key(cls) -> list[str]:
        return [n for n, c in cls.cols().items() if c.primary_key]

    @classmethod
    def star(cls, row: Ref) -> Any:
        """The default projection: all physical columns."""
        return {n: row[n] for n in cls.cols()}

    # ------------------------------------------------------------ rows

    @classmethod
    def raw(cls, source: DataFrame) -> Query:
        """All physical columns."""
        return Query.of(source.select(*cls.cols()) if cls.cols() else source)

    @classmethod
    def query(cls, source: DataFrame) -> Query:
        """The rows in the default projection."""
        raw = cls.raw(source)
        return Query.of(raw.df.select(*selection(cls.star(raw.row)))) if cls.cols() else raw

    @classmethod
    def of_rows(cls, spark: SparkSession, rows: list[tuple]) -> DataFrame:
        """An in-memory table; keys and unique columns are checked, values of mapped types are encoded."""
        kinds = [c.type for c in cls.cols().values()]
        rows = [tuple(k.encode(v) if isinstance(k, Mapped) else v for k, v in zip(kinds, r, strict=True)) for r in rows]
        df = spark.createDataFrame(rows, cls.schema())
        broken = violations(cls, df)
        if broken:
            raise ValueError(f"{cls.name or cls.__name__}: {'; '.join(broken)}")
        return df

    @classmethod
    def read(cls, query: Query) -> list[dict[str, Any]]:
        """The result of a query with the values of mapped columns (by name) decoded."""
        kinds = {n: c.type for n, c in cls.cols().items() if isinstance(c.type, Mapped)}
        return [{n: kinds[n].decode(v) if n in kinds else v for n, v in r.asDict().items()} for r in query.result()]

    @classmethod
    def follow(cls, query: Query, key: str, target: DataFrame, target_table: type[Table]) -> Query:
        """The target rows that a foreign key leads to, one for each row of ``query``."""
        fk = cls.foreign_keys[key]
        return query.join(target_table.query(target)).on(lambda a, b: _matches(a, b, fk)).map(lambda r: r[1])

    @classmethod
    def follow_both(cls, query: Query, key: str, other: str, target: DataFrame, target_table: type[Table]) -> Query:
        """Target rows that satisfy two foreign keys at once."""
        one, two = cls.foreign_keys[key], cls.foreign_keys[other]
        return query.join(target_table.query(target)).on(lambda a, b: _matches(a, b, one) & _matches(a, b, two)).map(lambda r: r[1])

    @classmethod
    def find_by(cls, column: str) -> Callable[[DataFrame, Any], Query]:
        """A query by the value of one column."""
        return lambda source, value: cls.query(source).filter(lambda r: r[column] == value)


def _matches(a: Ref, b: Ref, fk: ForeignKey) -> Column:
    out = None
    for x, y in zip(fk.columns, fk.target_columns, strict=True):
        out = (a[x] == b[y]) if out is None else out & (a[x] == b[y])
    return out


def violations(table: type[Table], df: DataFrame, targets: dict[str, DataFrame] | None = None) -> list[str]:
    """What of the table's constraints the rows break: primary keys, unique columns and indexes, foreign keys."""
    out = []
    sets = {"primary key": tuple(table.primary_key())} | {f"unique column {n}": (n,) for n, c in table.cols().items() if c.unique} | {f"unique index {n}": i.columns for n, i in table.indexes.items() if i.unique}
    for what, columns in sets.items():
        if columns:
            known = df.where(" and ".join(f"`{c}` is not null" for c in columns)) if what != "primary key" else df
            if not known.groupBy(*columns).count().where("count > 1").isEmpty():
                out.append(f"{what} ({', '.join(columns)}) isn't unique")
    for name, fk in table.foreign_keys.items():
        if targets and fk.target in targets:
            right = targets[fk.target].select(*(F.col(c).alias(f"__t{i}") for i, c in enumerate(fk.target_columns)))
            on = [F.col(c) == F.col(f"__t{i}") for i, c in enumerate(fk.columns)]
            held = df.where(" and ".join(f"`{c}` is not null" for c in fk.columns))
            if not held.join(right, on, "left_anti").isEmpty():
                out.append(f"foreign key {name} leads nowhere for some rows")
    return out


@dataclass
class Catalog:
    """Where declared tables are read from: Parquet below a folder, the session's tables, or given DataFrames."""

    spark: SparkSession
    folder: str | None = None
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def df(self, name: str) -> DataFrame:
        if name in self.frames:
            return self.frames[name]
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet") if self.folder else self.spark.table(name)

    def query(self, table: type[Table] | str) -> Query:
        return Query.of(self.df(table)) if isinstance(table, str) else table.query(self.df(table.name))


def jdbc(spark: SparkSession, url: str, table: str, *, partition: tuple[str, Any, Any, int] | None = None, **options: str) -> DataFrame:
    """A table of a JDBC database (PostgreSQL, MySQL, SQL Server, Oracle, DB2, Derby, H2, HSQLDB, SQLite, ...).

    Filters, limits and aggregates are pushed down.  ``partition`` (column, lower, upper, parts) reads in parallel.
    The driver's jar has to be on the class path.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("pushDownLimit", "true").option("pushDownAggregate", "true")
    if partition:
        for k, v in zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), partition, strict=True):
            reader = reader.option(k, v)
    return reader.options(**options).load()
