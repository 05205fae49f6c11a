"""Logical column types and what is known of a table beside its Spark schema."""

from __future__ import annotations

import datetime
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from enum import Enum
from fractions import Fraction
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ColumnType(Enum):
    INTEGER = int
    DECIMAL = float
    VARCHAR = str
    DATE = datetime.date
    TIMESTAMP = datetime.datetime

    def __str__(self) -> str:
        return self.name

    @property
    def spark(self) -> T.DataType:
        return _TO_SPARK[self]

    def accepts(self, value: Any) -> bool:
        """Whether a value, not None, may stand in a column of this type; whole numbers may in DECIMAL columns."""
        if isinstance(value, bool):
            return False
        if self is ColumnType.DECIMAL:
            return isinstance(value, (int, float))
        if self is ColumnType.DATE:
            return isinstance(value, datetime.date) and not isinstance(value, datetime.datetime)
        return isinstance(value, self.value)


_TO_SPARK = {
    ColumnType.INTEGER: T.LongType(),
    ColumnType.DECIMAL: T.DoubleType(),
    ColumnType.VARCHAR: T.StringType(),
    ColumnType.DATE: T.DateType(),
    ColumnType.TIMESTAMP: T.TimestampType(),
}
_FROM_SPARK = {
    T.ByteType: ColumnType.INTEGER,
    T.ShortType: ColumnType.INTEGER,
    T.IntegerType: ColumnType.INTEGER,
    T.LongType: ColumnType.INTEGER,
    T.FloatType: ColumnType.DECIMAL,
    T.DoubleType: ColumnType.DECIMAL,
    T.StringType: ColumnType.VARCHAR,
    T.DateType: ColumnType.DATE,
    T.TimestampType: ColumnType.TIMESTAMP,
    T.TimestampNTZType: ColumnType.TIMESTAMP,
}
#: Types of group keys and of privacy IDs.
KEY_TYPES = frozenset({ColumnType.INTEGER, ColumnType.VARCHAR, ColumnType.DATE})
NUMERIC = frozenset({ColumnType.INTEGER, ColumnType.DECIMAL})


@dataclass(frozen=True)
class ColumnDescriptor:
    column_type: ColumnType
    allow_null: bool = False
    allow_nan: bool = False
    allow_inf: bool = False

    def __post_init__(self) -> None:
        if self.column_type is not ColumnType.DECIMAL and (self.allow_nan or self.allow_inf):
            raise ValueError(f"{self.column_type} columns hold neither NaN nor infinity")

    @property
    def special(self) -> bool:
        return self.allow_null or self.allow_nan


def descriptor(given: ColumnDescriptor | ColumnType | str, nullable: bool = True) -> ColumnDescriptor:
    """A descriptor from what a caller states of a new column: a bare type may hold every special value."""
    if isinstance(given, ColumnDescriptor):
        return given
    kind = ColumnType[given.upper()] if isinstance(given, str) else given
    decimal = kind is ColumnType.DECIMAL
    return ColumnDescriptor(kind, nullable, decimal, decimal)


def column_type(data_type: T.DataType, name: str = "") -> ColumnType:
    found = _FROM_SPARK.get(type(data_type))
    if found is None:
        raise ValueError(f"column {name!r} has type {data_type.simpleString()}, which is not supported; convert it to one of {', '.join(map(str, ColumnType))} first")
    return found


def coerce(df: DataFrame) -> DataFrame:
    """The frame with each column in the Spark type of its logical type, in one projection."""
    names = df.columns
    if "" in names:
        raise ValueError("a column name may not be empty")
    if len(set(names)) != len(names):
        raise ValueError(f"column names occur twice: {sorted({n for n in names if names.count(n) > 1})}")
    kinds = [column_type(f.dataType, f.name).spark for f in df.schema.fields]
    if all(f.dataType == k for f, k in zip(df.schema.fields, kinds)):
        return df
    return df.select(*(quoted(f.name).cast(k).alias(f.name) for f, k in zip(df.schema.fields, kinds)))


def infer(df: DataFrame) -> dict[str, ColumnDescriptor]:
    out = {}
    for f in df.schema.fields:
        kind = column_type(f.dataType, f.name)
        decimal = kind is ColumnType.DECIMAL
        out[f.name] = ColumnDescriptor(kind, f.nullable, decimal, decimal)
    return out


def quoted(name: str):
    """A column by its very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


# How a table can differ between neighbours: by rows, by rows in some groups, or by all rows of an ID.


@dataclass(frozen=True)
class Rows:
    """At most `rows` rows differ."""

    rows: Fraction


@dataclass(frozen=True)
class Grouped:
    """At most `rows` rows differ in each of at most `groups` groups of a column."""

    column: str
    groups: Fraction
    rows: Fraction


@dataclass(frozen=True)
class Ids:
    """All rows of one ID differ."""

    space: str


Metric = Rows | Grouped | Ids


@dataclass(frozen=True)
class TableMeta:
    columns: Mapping[str, ColumnDescriptor]
    metric: Metric
    id_column: str | None = None
    constraints: tuple = field(default=())
    #: Tables that went into this one, for joins of a table with itself.
    sources: frozenset = field(default=frozenset())

    @property
    def grouping_column(self) -> str | None:
        return self.metric.column if isinstance(self.metric, Grouped) else None

    def but(self, **changes: Any) -> TableMeta:
        return replace(self, **changes)

    def require(self, names) -> None:
        missing = [n for n in names if n not in self.columns]
        if missing:
            raise ValueError(f"no such column: {', '.join(map(repr, missing))}; the table has {', '.join(map(repr, self.columns))}")
