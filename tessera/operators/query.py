"""The query type: a lazy, immutable, collection-style view of a DataFrame.

A row is a ``Ref``: its columns are attributes, the two sides of a joined row are ``r[0]`` and ``r[1]``.  Sides of joins
are struct columns, so a missing side of an outer join is a null struct and differs from a row of nulls; Catalyst takes
structs that are only looked into apart again, so filters and column pruning reach the scan.

Sorting and paging are kept pending: a later ``sort_by`` is the primary order and earlier ones break its ties, and chains of
``take`` and ``drop`` fold to one offset and one limit.  NULLs sort last both ways unless a key says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.numbering import with_index

_SORT = "__sort"
#: NaN's band, as it is the greatest value.
_LAST_BAND = 2**63 - 1


class Ref:
    """A row of a query, or one of its struct columns."""

    def __init__(self, schema: T.StructType, column: Column | None = None):
        self._schema, self._column = schema, column

    def _get(self, name: str) -> Any:
        if name not in self._schema.fieldNames():
            raise AttributeError(f"there is no column {name!r}; there are {', '.join(n for n in self._schema.fieldNames() if not n.startswith(_SORT))}")
        c = F.col(f"`{name}`") if self._column is None else self._column[name]
        kind = self._schema[name].dataType
        return Ref(kind, c) if isinstance(kind, T.StructType) else c

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__"):
            raise AttributeError(name)
        return self._get(name)

    def __getitem__(self, key: int | str) -> Any:
        return self._get(key if isinstance(key, str) else f"_{key + 1}")

    def __iter__(self):
        return (self._get(n) for n in self._names())

    def _names(self) -> list[str]:
        return [n for n in self._schema.fieldNames() if not n.startswith(_SORT)]

    @property
    def column(self) -> Column:
        """The whole row as one struct."""
        return self._column if self._column is not None else F.struct(*(F.col(f"`{n}`") for n in self._names()))

    @property
    def is_defined(self) -> Column:
        """Whether an optional row is there."""
        return self.column.isNotNull()

    @property
    def is_empty(self) -> Column:
        return self.column.isNull()

    def map(self, f: Callable[[Ref], Column]) -> Column:
        """``f`` of an optional row, NULL where it is missing."""
        return F.when(self.is_defined, f(self))


class OuterRef(Ref):
    """The outer row of a dependent query: its columns refer to the other side of the join."""

    def __init__(self, schema: T.StructType, path: str = "_1"):
        super().__init__(schema)
        self._path = path

    def _get(self, name: str) -> Any:
        path = f"{self._path}.`{name}`"
        kind = self._schema[name].dataType
        return OuterRef(kind, path) if isinstance(kind, T.StructType) else F.col(path).outer()

    @property
    def column(self) -> Column:
        return F.col(self._path).outer()


@dataclass(frozen=True)
class SortKey:
    """A sort key.  NULLs are last both ways unless ``nulls_first`` says otherwise."""

    column: Column
    descending: bool = False
    first: bool = False

    def reverse(self) -> SortKey:
        return replace(self, descending=not self.descending)

    def nulls_first(self) -> SortKey:
        return replace(self, first=True)

    def nulls_last(self) -> SortKey:
        return replace(self, first=False)

    nulls_default = nulls_last

    def of(self, column: Column) -> SortKey:
        """The same order of another column."""
        return replace(self, column=column)

    @property
    def ordered(self) -> Column:
        c = self.column
        if self.descending:
            return c.desc_nulls_first() if self.first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.first else c.asc_nulls_last()


def asc(c: Column) -> SortKey:
    return SortKey(c)


def desc(c: Column) -> SortKey:
    return SortKey(c, True)


def _keys(found: Any) -> list[SortKey]:
    """Sort keys from a column, a key, a row, or a tuple of these."""
    if isinstance(found, (tuple, list, Ref)):
        return [k for f in found for k in _keys(f)]
    return [found if isinstance(found, SortKey) else SortKey(found)]


def selection(found: Any) -> list[Column]:
    """What a projection's result selects: a dict names columns, a tuple counts them, a row gives its columns."""
    if isinstance(found, dict):
        return [(v.column if isinstance(v, Ref) else v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in found.items()]
    if isinstance(found, Ref):
        return [(v.column if isinstance(v, Ref) else v).alias(n) for n, v in zip(found._names(), found, strict=True)]
    if isinstance(found, tuple):
        return selection({f"_{i + 1}": v for i, v in enumerate(found)})
    return selection({"value": found})


class Query:
    """A lazy collection of rows."""

    def __init__(self, df: DataFrame, order: tuple[SortKey, ...] = (), offset: int = 0, fetch: int | None = None, schema: T.StructType | None = None):
        self._df, self._order, self._offset, self._fetch, self._known = df, order, offset, fetch, schema

    # ------------------------------------------------------------ sources

    @staticmethod
    def of(df: DataFrame) -> Query:
        return Query(df)

    @staticmethod
    def scalar(spark: SparkSession, **values: Any) -> Query:
        """One row of the given values or expressions."""
        return Query(spark.range(1).select(*selection(values)))

    @staticmethod
    def empty(spark: SparkSession) -> Query:
        return Query(spark.range(0))

    # ------------------------------------------------------------ state

    @property
    def _schema(self) -> T.StructType:
        """Asked of the DataFrame once only: with references to an outer row it can't be asked any more."""
        if self._known is None:
            self._known = self._df.schema
        return self._known

    @property
    def row(self) -> Ref:
        return Ref(self._schema)

    @property
    def columns(self) -> list[str]:
        return self.row._names()

    def _paged(self) -> bool:
        return bool(self._offset) or self._fetch is not None

    def _flat(self) -> DataFrame:
        """The rows with order and paging applied, the hidden sort keys kept."""
        df = self._df
        if self._order and self._paged():
            df = df.orderBy(*(k.ordered for k in self._order))
        if self._offset:
            df = df.offset(self._offset)
        if self._fetch is not None:
            df = df.limit(self._fetch)
        return df

    def _set(self) -> DataFrame:
        """The rows where their order doesn't matter any more."""
        return self._flat().select(*(F.col(f"`{n}`") for n in self.columns))

    def _inner(self) -> Query:
        """With paging applied, the order kept for later sorting."""
        return Query(self._flat(), self._order, schema=self._schema) if self._paged() else self

    @property
    def df(self) -> DataFrame:
        """The result as a DataFrame, sorted if the query is."""
        df = self._flat()
        if self._order:
            df = df.orderBy(*(k.ordered for k in self._order))
        return df.select(*(F.col(f"`{n}`") for n in self.columns))

    # ------------------------------------------------------------ projection and filters

    def map(self, f: Callable[[Ref], Any]) -> Query:
        """A row for each row."""
        q = self._inner()
        if not q._order:
            return Query(q._df.select(*selection(f(q.row))))
        # sort keys go along under hidden names, as the projection may drop what they need
        hidden, order = [], []
        for i, key in enumerate(q._order):
            hidden.append(key.column.alias(f"{_SORT}{i}"))
            order.append(key.of(F.col(f"{_SORT}{i}")))
        return Query(q._df.select(*selection(f(q.row)), *hidden), tuple(order))

    def filter(self, p: Callable[[Ref], Column]) -> Query:
        q = self._inner()
        return Query(q._df.filter(p(q.row)), q._order, schema=q._schema)

    with_filter = filter

    def filter_not(self, p: Callable[[Ref], Column]) -> Query:
        """Rows for which ``p`` is FALSE; NULL is neither."""
        return self.filter(lambda r: ~p(r))

    def filter_opt(self, value: Any, p: Callable[[Ref, Any], Column]) -> Query:
        """Filters only if there is a value."""
        return self if value is None else self.filter(lambda r: p(r, value))

    def filter_not_opt(self, value: Any, p: Callable[[Ref, Any], Column]) -> Query:
        return self if value is None else self.filter_not(lambda r: p(r, value))

    def filter_if(self, condition: bool, p: Callable[[Ref], Column]) -> Query:
        return self.filter(p) if condition else self

    def filter_not_if(self, condition: bool, p: Callable[[Ref], Column]) -> Query:
        return self.filter_not(p) if condition else self

    def flat_map(self, f: Callable[[Ref], Query]) -> Query:
        """Pairs of each row and the rows of ``f`` for it; its filters and sort keys may use the outer row."""
        left = self._set().select(F.struct(*(F.col(f"`{n}`") for n in self.columns)).alias("_1"))
        right = f(OuterRef(left.schema["_1"].dataType))
        inner = right._set().select(F.struct(*(F.col(f"`{n}`") for n in right.columns)).alias("_2"))
        return Query(left.lateralJoin(inner))

    def _as_rows(self) -> tuple[DataFrame, Ref, OuterRef]:
        """Whole rows as one struct, which no column of a subquery is named like."""
        df = self._set().select(F.struct(*(F.col(f"`{n}`") for n in self.columns)).alias("__row"))
        kind = T.StructType([f for f in self._schema.fields if f.name in self.columns])
        return df, Ref(kind, F.col("__row")), OuterRef(kind, "__row")

    def map_scalar(self, f: Callable[[Ref, OuterRef], Any]) -> Query:
        """As ``map``; scalar subqueries in it (``as_column``) use the second argument for columns of this row."""
        df, row, outer = self._as_rows()
        return Query(df.select(*selection(f(row, outer))))

    def filter_scalar(self, p: Callable[[Ref, OuterRef], Column]) -> Query:
        """As ``filter``; scalar subqueries in it (``as_column``) use the second argument for columns of this row."""
        df, row, outer = self._as_rows()
        return Query(df.where(p(row, outer)).select("__row.*"))

    def subquery(self) -> Query:
        """Paging and order applied; no barrier is needed, as the meaning never depends on one."""
        return self._inner()

    def for_update(self) -> Query:
        """Rows aren't locked: a read of files sees one version of them anyway."""
        return self

    for_share = for_update

    # ------------------------------------------------------------ joins

    def join(self, other: Query) -> Join:
        return Join(self, other, "inner")

    def join_left(self, other: Query) -> Join:
        return Join(self, other, "left")

    def join_right(self, other: Query) -> Join:
        return Join(self, other, "right")

    def join_full(self, other: Query) -> Join:
        return Join(self, other, "full")

    def exists(self, other: Query, on: Callable[[Ref, Ref], Column]) -> Query:
        """Rows for which ``other`` has a row that satisfies ``on``."""
        return self._half(other, on, "left_semi")

    def not_exists(self, other: Query, on: Callable[[Ref, Ref], Column]) -> Query:
        return self._half(other, on, "left_anti")

    def is_in(self, key: Callable[[Ref], Any], other: Query) -> Query:
        """Rows whose key (a column, or a tuple of them) is a row of ``other``."""
        return self._half(other, self._same(key, other), "left_semi")

    def is_not_in(self, key: Callable[[Ref], Any], other: Query) -> Query:
        """As SQL's NOT IN: nothing if ``other`` holds a NULL, and no row whose key is NULL unless ``other`` is empty."""
        mine = key(self.row)
        if isinstance(mine, tuple):
            raise ValueError("NOT IN takes one column")
        name = other.columns[0]
        right = other._set().select(F.col(f"`{name}`").alias("__in"))
        # an equi-join, which hashes or sorts at any size, and one number about the other side for the NULLs
        held = right.select(F.when(F.count(F.lit(1)) == 0, "empty").when(F.count_if(F.col("__in").isNull()) == 0, "values").otherwise("null")).scalar()
        left = self._flat().where((held == "empty") | ((held == "values") & mine.isNotNull()))
        return Query(left.join(right.where("__in is not null"), mine == F.col("__in"), "left_anti"), self._order)

    def _same(self, key: Callable[[Ref], Any], other: Query) -> Callable[[Ref, Ref], Column]:
        def on(a: Ref, b: Ref) -> Column:
            mine = key(a)
            out = None
            for x, y in zip(mine if isinstance(mine, tuple) else (mine,), b, strict=True):
                out = (x == y) if out is None else out & (x == y)
            return out

        return on

    def _half(self, other: Query, on: Callable[[Ref, Ref], Column], how: str) -> Query:
        right = other._set().select(F.struct(*(F.col(f"`{n}`") for n in other.columns)).alias("__other"))
        return Query(self._flat().join(right, on(self.row, Ref(right.schema["__other"].dataType, F.col("__other"))), how), self._order)

    def zip(self, other: Query) -> Query:
        """Pairs of the rows at equal places, as many as the shorter side has."""
        a, b = self._numbered("_1", "__i"), other._numbered("_2", "__j")
        return Query(a.join(b, F.col("__i") == F.col("__j")).select("_1", "_2", F.col("__i").alias(f"{_SORT}0")), (SortKey(F.col(f"{_SORT}0")),))

    def zip_with(self, other: Query, f: Callable[[Ref, Ref], Any]) -> Query:
        return self.zip(other).map(lambda r: f(r[0], r[1]))

    def zip_with_index(self) -> Query:
        """(row, its place from 0), the place as a bigint."""
        return Query(self._numbered("_1", "_2"), (SortKey(F.col("_2")),))

    def _numbered(self, side: str, index: str) -> DataFrame:
        q = self._inner()
        keys = [k.column.alias(f"__key{i}") for i, k in enumerate(q._order)]
        rows = q._df.select(F.struct(*(F.col(f"`{n}`") for n in q.columns)).alias(side), *keys)
        return with_index(rows, [k.of(F.col(f"__key{i}")).ordered for i, k in enumerate(q._order)], index).select(side, index)

    # ------------------------------------------------------------ groups and aggregates

    def group_by(self, key: Callable[[Ref], Any]) -> Grouped:
        return Grouped(self._inner(), key)

    def aggregate(self, f: Callable[[Group], Any]) -> Query:
        """Aggregates over all rows: one row."""
        df = self._set()
        # a select, as agg would ask for a schema that references to an outer row don't let be known yet
        return Query(df.select(*selection(f(Group(self.row)))))

    def length(self) -> Query:
        return self.aggregate(lambda g: g.length)

    def as_column(self) -> Column:
        """The only value of a query of one column as a scalar subquery: NULL without rows, an error beyond one.

        Inside ``map_scalar`` and ``filter_scalar`` it may look at the outer row that these hand over.
        """
        if self._order or self._paged():
            return self._set().scalar()
        return self._df.scalar()

    def distinct(self) -> Query:
        """Whole rows once.  Which of them was first is lost, so the order is too."""
        return Query(self._set().distinct())

    def distinct_on(self, key: Callable[[Ref], Any]) -> Query:
        """One whole row for each key: the first by the query's order, and among equals by all columns."""
        from pyspark.sql import Window

        q = self._inner()
        keys = [c for c in selection(key(q.row))]
        rest = [F.col(f"`{n}`").asc_nulls_last() for n in q.columns]
        first = F.row_number().over(Window.partitionBy(*keys).orderBy(*(k.ordered for k in q._order), *rest))
        return Query(q._df.withColumn("__first", first).where("__first = 1").drop("__first"), q._order)

    # ------------------------------------------------------------ order and paging

    def sort_by(self, key: Callable[[Ref], Any]) -> Query:
        """The new keys come first, keys of earlier sorts break their ties."""
        q = self._inner()
        return Query(q._df, (*_keys(key(q.row)), *q._order), schema=q._schema)

    def sorted(self) -> Query:
        """By all columns."""
        return self.sort_by(lambda r: r)

    def take(self, n: int) -> Query:
        fetch = n if self._fetch is None else min(n, self._fetch)
        return Query(self._df, self._order, self._offset, max(0, fetch), self._schema)

    def drop(self, n: int) -> Query:
        fetch = None if self._fetch is None else max(0, self._fetch - n)
        return Query(self._df, self._order, self._offset + n, fetch, self._schema)

    # ------------------------------------------------------------ unions

    def union(self, other: Query) -> Query:
        """Rows of both without duplicates; columns are matched by position."""
        return Query(self._set().union(other._set()).distinct())

    def union_all(self, other: Query) -> Query:
        return Query(self._set().union(other._set()))

    __add__ = union_all

    # ------------------------------------------------------------ results

    def result(self) -> list[Row]:
        return self.df.collect()

    def head(self) -> Row:
        """The first row; an error if there is none."""
        found = self.head_option()
        if found is None:
            raise LookupError("the query has no rows")
        return found

    def head_option(self) -> Row | None:
        rows = self.take(1).df.collect()
        return rows[0] if rows else None

    def to(self, kind: Callable[[Any], Any]) -> Any:
        """The result in a collection of the client; a set has equal rows once."""
        return kind((self.distinct() if kind in (set, frozenset) else self).result())

    def statement(self) -> str:
        """The plan that would run."""
        return self.df._jdf.queryExecution().toString()


class Join:
    """A join whose condition isn't given yet; without one every pair of rows is joined."""

    def __init__(self, left: Query, right: Query, how: str):
        self._left, self._right, self._how = left, right, how

    def _sides(self) -> tuple[DataFrame, DataFrame]:
        return tuple(q._set().select(F.struct(*(F.col(f"`{n}`") for n in q.columns)).alias(side)) for q, side in ((self._left, "_1"), (self._right, "_2")))

    def on(self, p: Callable[[Ref, Ref], Column]) -> Query:
        """Any predicate over a row of each side."""
        a, b = self._sides()
        return Query(a.join(b, p(Ref(a.schema["_1"].dataType, F.col("_1")), Ref(b.schema["_2"].dataType, F.col("_2"))), self._how))

    def on_range(self, value: Callable[[Ref], Column], low: Callable[[Ref], Column], high: Callable[[Ref], Column], width: float, p: Callable[[Ref, Ref], Column]) -> Query:
        """As ``on`` for an inner join whose ``p`` implies that ``value`` of the right row lies from ``low`` to ``high`` of the left one.

        Such values are cut into bands of ``width``; a left row goes to each band from ``low`` to ``high``, and an equal band joins the
        equalities of ``p``.  So rows are only compared with those of the bands they reach, not with all that ``p``'s equalities leave,
        and the work is spread by band.  ``p`` is still asked of every pair, and a pair meets in one band, that of ``value``: the result
        is that of ``on(p)``, for any width.  A width of a fraction of the range is right; ranges of many bands are copied as often.

        NULL is in no range.  NaN is the greatest value and equals itself; a range has to be finite or one infinite value.
        """
        if self._how != "inner":
            raise ValueError("a range joins inner rows only")
        if not width > 0:
            raise ValueError("the width of a band is over 0")

        def band(c: Column) -> Column:
            # rounding and floor keep the order, so the band of a value in the range is one of the range's bands
            d = c.cast("double")
            return F.when(F.isnan(d), F.lit(_LAST_BAND)).otherwise(F.floor(d / F.lit(float(width))))

        left, right = self._left._set(), self._right._set()
        mine, other = Ref(self._left._schema), Ref(self._right._schema)
        a = left.where(low(mine) <= high(mine)).select("*", F.explode(F.sequence(band(low(mine)), band(high(mine)))).alias("__band"))
        a = a.select(F.struct(*(F.col(f"`{n}`") for n in self._left.columns)).alias("_1"), F.col("__band").alias("__reached"))
        b = right.select(F.struct(*(F.col(f"`{n}`") for n in self._right.columns)).alias("_2"), band(value(other)).alias("__band"))
        on = p(Ref(a.schema["_1"].dataType, F.col("_1")), Ref(b.schema["_2"].dataType, F.col("_2")))
        # shuffled: a broadcast would leave all pairs to the few tasks that read a small file
        return Query(a.join(b.hint("merge"), (F.col("__reached") == F.col("__band")) & on).select("_1", "_2"))

    def all(self) -> Query:
        """Without a condition: the cross product, with outer rows where the other side is empty."""
        a, b = self._sides()
        return Query(a.crossJoin(b) if self._how == "inner" else a.join(b, F.lit(True), self._how))

    def __getattr__(self, name: str) -> Any:
        """A join without ``on`` is used as the query it is."""
        return getattr(self.all(), name)


class Group:
    """The rows of a group.  It has aggregates only: there are no collections in results."""

    def __init__(self, row: Ref, condition: Column | None = None, value: Column | None = None):
        self._row, self._condition, self._value = row, condition, value

    def filter(self, p: Callable[[Ref], Column]) -> Group:
        """Aggregates over those rows only; with no row left counts are 0 and others NULL."""
        c = p(self._row)
        return Group(self._row, c if self._condition is None else self._condition & c, self._value)

    def map(self, f: Callable[[Ref], Column]) -> Group:
        """Aggregates of an expression."""
        return Group(self._row, self._condition, f(self._row))

    def _of(self, value: Column | None = None) -> Column:
        v = value if value is not None else self._value
        if v is None:
            raise ValueError("map the group to a column first")
        if isinstance(v, Ref):
            v = v.column
        return v if self._condition is None else F.when(self._condition, v)

    @property
    def length(self) -> Column:
        """Rows, NULLs too."""
        return F.count(F.lit(1)) if self._condition is None else F.count_if(self._condition)

    size = length

    @property
    def count_defined(self) -> Column:
        return F.count(self._of())

    @property
    def count_distinct(self) -> Column:
        """Distinct values that aren't NULL; of tuples and rows all distinct ones, NULLs in them included."""
        v = self._value
        if isinstance(v, tuple):
            v = F.struct(*v)
        return F.count_distinct(self._of(v))

    @property
    def sum(self) -> Column:
        """NULL without values; whole numbers add up to a bigint."""
        return F.sum(self._of())

    @property
    def avg(self) -> Column:
        return F.avg(self._of().cast("double"))

    @property
    def min(self) -> Column:
        return F.min(self._of())

    @property
    def max(self) -> Column:
        return F.max(self._of())


class Grouped:
    def __init__(self, query: Query, key: Callable[[Ref], Any]):
        self._query, self._key = query, key

    def map(self, f: Callable[[Any, Group], Any]) -> Query:
        """``f`` of the key and the group.  A row for each key; a NULL key is a group too."""
        q = self._query
        found = self._key(q.row)
        keys = selection(found)
        names = [f"__key{i}" for i in range(len(keys))]
        keyed = q._set().withColumns({n: k for n, k in zip(names, keys, strict=True)})
        cols = [F.col(n) for n in names]
        if isinstance(found, Ref):
            shape = T.StructType([T.StructField(n, keyed.schema[k].dataType) for n, k in zip(found._names(), names, strict=True)])
            key: Any = Ref(shape, F.struct(*(c.alias(n) for c, n in zip(cols, found._names(), strict=True))))
        elif isinstance(found, dict):
            key = dict(zip(found, cols, strict=True))
        else:
            key = tuple(cols) if isinstance(found, tuple) else cols[0]
        wanted = selection(f(key, Group(q.row)))
        return Query(keyed.groupBy(*names).agg(*wanted).drop(*names))
