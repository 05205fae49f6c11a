"""What is to be hidden, and bounds on what an ID contributes."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .types import quoted


def _positive(value, name: str) -> None:
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{name} has to be a whole number")
    if value < 1:
        raise ValueError(f"{name} has to be at least 1")


class ProtectedChange:
    """Base of the changes that a session hides."""


@dataclass(frozen=True)
class AddMaxRows(ProtectedChange):
    """Up to max_rows rows come or go."""

    max_rows: int

    def __post_init__(self):
        _positive(self.max_rows, "max_rows")


class AddOneRow(AddMaxRows):
    """One row comes or goes."""

    def __init__(self):
        super().__init__(1)


@dataclass(frozen=True)
class AddMaxRowsInMaxGroups(ProtectedChange):
    """Up to max_rows_per_group rows come or go in each of up to max_groups groups of a column."""

    grouping_column: str
    max_groups: int
    max_rows_per_group: int

    def __post_init__(self):
        if not self.grouping_column:
            raise ValueError("grouping_column may not be empty")
        _positive(self.max_groups, "max_groups")
        _positive(self.max_rows_per_group, "max_rows_per_group")


@dataclass(frozen=True)
class AddRowsWithID(ProtectedChange):
    """All rows of one ID come or go, in all tables of an ID space."""

    id_column: str
    id_space: str = "default_id_space"

    def __post_init__(self):
        if not self.id_column or not self.id_space:
            raise ValueError("id_column and id_space may not be empty")


def by_content(df: DataFrame) -> list:
    """An order that depends on the rows' contents alone; equal rows are interchangeable."""
    names = [quoted(n) for n in df.columns]
    return [F.xxhash64(*names), *names]


class Constraint:
    """Base of the bounds on what an ID contributes. Enforcing keeps rows by their content alone."""

    def enforce(self, df: DataFrame, id_column: str) -> DataFrame:
        raise NotImplementedError


def _ranked(df: DataFrame, rank, window, most: int) -> DataFrame:
    return df.select("*", rank.over(window).alias("__rank")).where(F.col("__rank") <= most).drop("__rank")


@dataclass(frozen=True)
class MaxRowsPerID(Constraint):
    """At most max rows for each ID."""

    max: int

    def __post_init__(self):
        _positive(self.max, "max")

    def enforce(self, df, id_column):
        return _ranked(df, F.row_number(), W.partitionBy(quoted(id_column)).orderBy(*by_content(df)), self.max)


@dataclass(frozen=True)
class MaxGroupsPerID(Constraint):
    """Rows in at most max groups of a column for each ID."""

    grouping_column: str
    max: int

    def __post_init__(self):
        if not self.grouping_column:
            raise ValueError("grouping_column may not be empty")
        _positive(self.max, "max")

    def enforce(self, df, id_column):
        # groups are ranked without their rows, so an ID with very many rows costs no more than its groups
        pairs = df.select(quoted(id_column).alias("__id"), quoted(self.grouping_column).alias("__group")).distinct()
        kept = _ranked(pairs, F.row_number(), W.partitionBy("__id").orderBy(F.xxhash64("__id", "__group"), "__group"), self.max)
        return df.join(kept, quoted(id_column).eqNullSafe(F.col("__id")) & quoted(self.grouping_column).eqNullSafe(F.col("__group")), "left_semi")


@dataclass(frozen=True)
class MaxRowsPerGroupPerID(Constraint):
    """At most max rows for each pair of ID and value of a column."""

    grouping_column: str
    max: int

    def __post_init__(self):
        if not self.grouping_column:
            raise ValueError("grouping_column may not be empty")
        _positive(self.max, "max")

    def enforce(self, df, id_column):
        return _ranked(df, F.row_number(), W.partitionBy(quoted(id_column), quoted(self.grouping_column)).orderBy(*by_content(df)), self.max)


def simplify(constraints) -> tuple[Constraint, ...]:
    """The tightest of each kind and column."""
    best: dict = {}
    for c in constraints:
        key = (type(c), getattr(c, "grouping_column", None))
        if key not in best or c.max < best[key].max:
            best[key] = c
    return tuple(best.values())


class TruncationStrategy:
    """How a private join of row tables bounds the rows of a join key on one side."""

    class Type(Enum):
        DROP_EXCESS = "drop_excess"
        DROP_NON_UNIQUE = "drop_non_unique"

    @dataclass(frozen=True)
    class DropExcess:
        """Keeps max_rows rows of each join key."""

        max_rows: int

        def __post_init__(self):
            _positive(self.max_rows, "max_rows")

        #: Rows that the kept ones can differ by if one row comes or goes.
        stability = Fraction(2)

        def apply(self, df: DataFrame, keys: list[str]) -> DataFrame:
            return _ranked(df, F.row_number(), W.partitionBy(*map(quoted, keys)).orderBy(*by_content(df)), self.max_rows)

    @dataclass(frozen=True)
    class DropNonUnique:
        """Drops every join key that has more than one row."""

        stability = Fraction(1)
        max_rows = 1

        def apply(self, df: DataFrame, keys: list[str]) -> DataFrame:
            # aggregated before the shuffle, so a key with very many rows is nowhere held
            rows = F.any_value(F.struct(*map(quoted, df.columns))).alias("__row")
            found = df.groupBy(*(quoted(k).alias(f"__key_{i}") for i, k in enumerate(keys))).agg(F.count(F.lit(1)).alias("__rows"), rows)
            return found.where("__rows = 1").select("__row.*")
