"""Metadata of a session's tables, a model of them, and table classes generated from it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.sources.table import Mapped, Table


def tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database))


def columns(spark: SparkSession, table: str) -> list[tuple[str, str, bool]]:
    """(name, type, nullable) in order."""
    return [(c.name, c.dataType, c.nullable) for c in spark.catalog.listColumns(table)]


def functions(spark: SparkSession) -> list[str]:
    return sorted({f.name for f in spark.catalog.listFunctions()})


def databases(spark: SparkSession) -> list[str]:
    return sorted(d.name for d in spark.catalog.listDatabases())


def catalogs(spark: SparkSession) -> list[str]:
    return sorted(c.name for c in spark.catalog.listCatalogs())


def table_types(spark: SparkSession, database: str | None = None) -> dict[str, str]:
    """By table whether it is managed, external, a view or a temporary view."""
    return {t.name: t.tableType for t in spark.catalog.listTables(database)}


#: The table property that holds the declared constraints.
CONSTRAINTS = "tessera.constraints"


def constraints_of(table: type[Table]) -> dict:
    """What a declaration says beyond column types, as plain data."""
    return {
        "primary_key": table.primary_key(),
        "unique": [n for n, c in table.cols().items() if c.unique],
        "auto_inc": [n for n, c in table.cols().items() if c.auto_inc],
        "foreign_keys": {n: [list(k.columns), k.target, list(k.target_columns), k.on_update, k.on_delete] for n, k in table.foreign_keys.items()},
        "indexes": {n: [list(i.columns), i.unique] for n, i in table.indexes.items()},
    }


def constraints(spark: SparkSession, table: str) -> dict:
    """The declared constraints of a table of the session; without any, empty ones."""
    held = {r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES `{table}`").collect()}.get(CONSTRAINTS)
    return json.loads(held) if held else {"primary_key": [], "unique": [], "auto_inc": [], "foreign_keys": {}, "indexes": {}}


def primary_keys(spark: SparkSession, table: str) -> list[str]:
    return constraints(spark, table)["primary_key"]


def imported_keys(spark: SparkSession, table: str) -> list[tuple[str, tuple[str, ...], str, tuple[str, ...]]]:
    """(name, columns, target, its columns) of the foreign keys of a table."""
    return [(n, tuple(k[0]), k[1], tuple(k[2])) for n, k in sorted(constraints(spark, table)["foreign_keys"].items())]


def exported_keys(spark: SparkSession, table: str, database: str | None = None) -> list[tuple[str, str, tuple[str, ...], tuple[str, ...]]]:
    """(table, key name, its columns, the columns here) of the foreign keys that lead to a table."""
    return [(t, n, cols, there) for t in tables(spark, database) for n, cols, target, there in (imported_keys(spark, t) if table_types(spark, database)[t] in ("MANAGED", "EXTERNAL") else []) if target == table]


def cross_reference(spark: SparkSession, target: str, table: str) -> list[tuple[str, tuple[str, ...], tuple[str, ...]]]:
    """The foreign keys that lead from ``table`` to ``target``."""
    return [(n, cols, there) for n, cols, to, there in imported_keys(spark, table) if to == target]


def indexes(spark: SparkSession, table: str) -> list[tuple[str, tuple[str, ...], bool]]:
    """(name, columns, unique); files have none, these are declared."""
    return [(n, tuple(i[0]), i[1]) for n, i in sorted(constraints(spark, table)["indexes"].items())]


def best_row_identifier(spark: SparkSession, table: str) -> list[str]:
    """The primary key, or the first unique column, or nothing."""
    held = constraints(spark, table)
    return held["primary_key"] or held["unique"][:1]


def column_defaults(spark: SparkSession, table: str) -> dict[str, str]:
    """Defaults as SQL, by column."""
    return {f.name: f.metadata["CURRENT_DEFAULT"] for f in spark.table(table).schema if "CURRENT_DEFAULT" in f.metadata}


def none_of_these(_: SparkSession) -> list:
    """Procedures, their columns, user-defined types and their attributes, super types and tables, privileges, version
    columns and client properties: a session's catalogue has none."""
    return []


procedures = procedure_columns = udts = attributes = super_types = super_tables = column_privileges = table_privileges = version_columns = client_info_properties = none_of_these


def types() -> list[str]:
    return sorted({"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "string", "binary", "date", "timestamp", "timestamp_ntz"})


@dataclass(frozen=True)
class ColumnModel:
    name: str
    type: str
    nullable: bool
    primary_key: bool = False
    auto_inc: bool = False
    unique: bool = False
    default: Any = None
    length: int | None = None


@dataclass(frozen=True)
class TableModel:
    name: str
    columns: tuple[ColumnModel, ...]
    foreign_keys: dict[str, tuple[tuple[str, ...], str, tuple[str, ...]]] = field(default_factory=dict)
    indexes: dict[str, tuple[tuple[str, ...], bool]] = field(default_factory=dict)


@dataclass(frozen=True)
class Model:
    tables: tuple[TableModel, ...]


def model(frames: dict[str, DataFrame | T.StructType], keys: dict[str, list[str]] | None = None, foreign_keys: dict[str, dict[str, tuple[tuple[str, ...], str, tuple[str, ...]]]] | None = None) -> Model:
    """A model from schemas and declared keys; keys of unknown columns are an error."""
    out = []
    for name, frame in sorted(frames.items()):
        schema = frame.schema if isinstance(frame, DataFrame) else frame
        key = (keys or {}).get(name, [])
        if unknown := set(key) - set(schema.fieldNames()):
            raise ValueError(f"{name} has no column {', '.join(sorted(unknown))}")
        out.append(TableModel(name, tuple(ColumnModel(f.name, f.dataType.simpleString(), f.nullable and f.name not in key, f.name in key) for f in schema), (foreign_keys or {}).get(name, {})))
    return Model(tuple(out))


def model_of(*tables: type[Table]) -> Model:
    """A model from declared tables."""
    out = []
    for t in sorted(tables, key=lambda t: t.name):
        cols = tuple(ColumnModel(n, c.spark_type.simpleString(), c.nullable, c.primary_key, c.auto_inc, c.unique, c.type.encode(c.default) if isinstance(c.type, Mapped) else c.default, c.length) for n, c in t.cols().items())
        out.append(TableModel(t.name, cols, {n: (k.columns, k.target, k.target_columns) for n, k in t.foreign_keys.items()}, {n: (i.columns, i.unique) for n, i in t.indexes.items()}))
    return Model(tuple(out))


def model_of_session(spark: SparkSession, names: list[str] | None = None) -> Model:
    """A model of the session's tables with the constraints that ``create_statements`` left with them."""
    out = []
    for name in sorted(names if names is not None else [t for t, k in table_types(spark).items() if k in ("MANAGED", "EXTERNAL")]):
        held, defaults = constraints(spark, name), column_defaults(spark, name)
        cols, lengths = [], {f.name: f.metadata.get("__CHAR_VARCHAR_TYPE_STRING", "") for f in spark.table(name).schema}
        for column, kind, nullable in columns(spark, name):
            length = int(lengths[column][8:-1]) if lengths[column].startswith("varchar(") else None
            value = spark.sql(f"SELECT {defaults[column]}").first()[0] if column in defaults else None
            cols.append(ColumnModel(column, "string" if length else kind, nullable and column not in held["primary_key"], column in held["primary_key"], column in held["auto_inc"], column in held["unique"], value, length))
        out.append(TableModel(name, tuple(cols), {n: (tuple(k[0]), k[1], tuple(k[2])) for n, k in held["foreign_keys"].items()}, {n: (tuple(i[0]), i[1]) for n, i in held["indexes"].items()}))
    return Model(tuple(out))


def class_name(table: str) -> str:
    return "".join(part.capitalize() for part in table.replace("-", "_").split("_")) or "Table"


def source_code(m: Model) -> str:
    """Python source of a table class for each table of the model."""
    lines = ['"""Generated table classes."""', "", "from tessera.sources.table import Col, ForeignKey, Index, Table"]
    for t in m.tables:
        lines += ["", "", f"class {class_name(t.name)}(Table):", f"    name = {t.name!r}"]
        for c in t.columns:
            options = "".join(f", {k}=True" for k, v in (("nullable", c.nullable), ("primary_key", c.primary_key), ("auto_inc", c.auto_inc), ("unique", c.unique)) if v)
            options += "".join(f", {k}={v!r}" for k, v in (("default", c.default), ("length", c.length)) if v is not None)
            ident = c.name if c.name.isidentifier() else None
            lines.append(f"    {ident} = Col({c.type!r}{options})" if ident else f"    locals()[{c.name!r}] = Col({c.type!r}{options})")
        if t.foreign_keys:
            lines.append("    foreign_keys = {")
            lines += [f"        {n!r}: ForeignKey({cols!r}, {target!r}, {there!r})," for n, (cols, target, there) in t.foreign_keys.items()]
            lines.append("    }")
        if t.indexes:
            lines.append("    indexes = {")
            lines += [f"        {n!r}: Index({cols!r}, {unique!r})," for n, (cols, unique) in t.indexes.items()]
            lines.append("    }")
    return "\n".join(lines) + "\n"
