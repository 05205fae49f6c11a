"""The fluent builder of queries. Builders are immutable: every method gives a new one."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import replace
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame

from .functions.binning import BinningSpec
from .config import config
from .keyset import KeySet, KeySetPlan
from .plans import ir
from .protect import Constraint
from .types import ColumnDescriptor, ColumnType, descriptor


def _text(value, what: str) -> str:
    if not isinstance(value, str):
        raise TypeError(f"{what} has to be a string")
    if not value:
        raise ValueError(f"{what} may not be empty")
    return value


def _columns(given: str | Iterable[str] | None, what: str = "columns") -> tuple[str, ...]:
    if given is None:
        return ()
    names = (given,) if isinstance(given, str) else tuple(given)
    for n in names:
        _text(n, f"each of {what}")
    if len(set(names)) != len(names):
        raise ValueError(f"{what} names a column twice")
    return names


def _new(types: Mapping[str, Any]) -> tuple[tuple[str, ColumnDescriptor], ...]:
    if not types:
        raise ValueError("new_column_types may not be empty")
    return tuple((_text(n, "a column name"), descriptor(d)) for n, d in types.items())


def _mechanism(given) -> str:
    return given.value if isinstance(given, Enum) else _text(given, "mechanism").lower()


class Query:
    """A finished query, which a session evaluates."""

    def __init__(self, plan: ir.Aggregate):
        self._plan = plan

    def __eq__(self, other) -> bool:
        return type(other) is type(self) and self._plan == other._plan

    def __hash__(self) -> int:
        return hash((self._plan.child, self._plan.kind, self._plan.names))

    def _is_equivalent(self, other) -> bool | None:
        """Whether both are the same query, as far as their key sets tell without running; else None."""
        if not isinstance(other, Query):
            return False
        a, b = self._plan, other._plan
        if replace(a, keys=None) != replace(b, keys=None):
            return False
        if isinstance(a.keys, KeySet) and isinstance(b.keys, KeySet):
            return a.keys.is_equivalent(b.keys)
        return a.keys == b.keys

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self._plan.kind} of {self._plan.names})"


class GroupbyCountQuery(Query):
    """A count, which can leave out small results."""

    def suppress(self, threshold: float) -> Query:
        """Keeps results of at least threshold; this looks at noisy results alone."""
        if isinstance(threshold, bool) or not isinstance(threshold, (int, float)):
            raise TypeError("threshold has to be a number")
        return Query(replace(self._plan, threshold=threshold))


class _Aggregations:
    """The aggregations that builders and grouped builders share."""

    _node: ir.Node
    _keys: Any

    def _query(self, kind: str, names, **parts) -> Query:
        names = tuple(_text(n, "an output name") for n in names)
        made = ir.Aggregate(self._node, self._keys, kind, names, **parts)
        return (GroupbyCountQuery if kind == "count" else Query)(made)

    def count(self, name: str | None = None, mechanism="default") -> GroupbyCountQuery:
        return self._query("count", [name or "count"], mechanism=_mechanism(mechanism))

    def count_distinct(self, columns=None, name: str | None = None, mechanism="default") -> Query:
        """Distinct rows over columns, or over all that are not group keys. Null, NaN and infinities are values."""
        chosen = _columns(columns)
        default = f"count_distinct({', '.join(chosen)})" if chosen else "count_distinct"
        return self._query("count_distinct", [name or default], columns=chosen or None, mechanism=_mechanism(mechanism))

    def _bounded(self, kind, column, low, high, name, mechanism) -> Query:
        _text(column, "column")
        for x in (low, high):
            if isinstance(x, bool) or not isinstance(x, (int, float)):
                raise TypeError("bounds have to be numbers")
        if not low < high:
            raise ValueError(f"the lower bound has to be under the upper one, not {low} and {high}")
        return self._query(kind, [name or f"{column}_{kind}"], column=column, low=low, high=high, mechanism=_mechanism(mechanism))

    def sum(self, column: str, low: float, high: float, name: str | None = None, mechanism="default") -> Query:
        return self._bounded("sum", column, low, high, name, mechanism)

    def average(self, column: str, low: float, high: float, name: str | None = None, mechanism="default") -> Query:
        """The mean of clamped values; the middle of the bounds where there are none."""
        return self._bounded("average", column, low, high, name, mechanism)

    def variance(self, column: str, low: float, high: float, name: str | None = None, mechanism="default") -> Query:
        """The sample variance of clamped values; NaN where there are fewer than two."""
        return self._bounded("variance", column, low, high, name, mechanism)

    def stdev(self, column: str, low: float, high: float, name: str | None = None, mechanism="default") -> Query:
        return self._bounded("stdev", column, low, high, name, mechanism)

    def quantile(self, column: str, quantile: float, low: float, high: float, name: str | None = None) -> Query:
        if isinstance(quantile, bool) or not isinstance(quantile, (int, float)) or not 0 <= quantile <= 1:
            raise ValueError("the quantile has to be a number from 0 to 1")
        query = self._bounded("quantile", column, low, high, name or f"{column}_quantile({quantile})", "default")
        return Query(replace(query._plan, quantile=quantile))

    def min(self, column: str, low: float, high: float, name: str | None = None) -> Query:
        return self.quantile(column, 0, low, high, name or f"{column}_min")

    def max(self, column: str, low: float, high: float, name: str | None = None) -> Query:
        return self.quantile(column, 1, low, high, name or f"{column}_max")

    def median(self, column: str, low: float, high: float, name: str | None = None) -> Query:
        return self.quantile(column, 0.5, low, high, name or f"{column}_median")

    def get_bounds(self, column: str, lower_bound_column: str | None = None, upper_bound_column: str | None = None) -> Query:
        """A power of two, and its negative, that hold nearly all values of a column."""
        _text(column, "column")
        names = [lower_bound_column or f"{column}_lower_bound", upper_bound_column or f"{column}_upper_bound"]
        if names[0] == names[1]:
            raise ValueError("the bounds need two names")
        return self._query("get_bounds", names, column=column)


class GroupedQueryBuilder(_Aggregations):
    """What groupby gives: only aggregations are left."""

    def __init__(self, node: ir.Node, keys):
        self._node, self._keys = node, keys


class QueryBuilder(_Aggregations):
    """Begins at a private table or view."""

    def __init__(self, source_id: str, _node: ir.Node | None = None):
        if _node is None:
            _text(source_id, "source_id")
            if not source_id.isidentifier():
                raise ValueError(f"{source_id!r} is not an identifier")
        self._source_id = source_id
        self._node = _node or ir.Source(source_id)

    @property
    def _keys(self):
        return KeySet.from_dict({})

    def _then(self, node: ir.Node) -> QueryBuilder:
        return QueryBuilder(self._source_id, node)

    def clone(self) -> QueryBuilder:
        return self._then(self._node)

    def join_public(self, public_table: DataFrame | str, join_columns=None, how: str = "inner") -> QueryBuilder:
        """A null-safe natural join with a public table; how is inner or left."""
        if not isinstance(public_table, (str, DataFrame)):
            raise TypeError("public_table has to be a table's name or a DataFrame")
        return self._then(ir.JoinPublic(self._node, public_table, None if join_columns is None else _columns(join_columns), how))

    def join_private(self, right_operand: QueryBuilder | str, truncation_strategy_left=None, truncation_strategy_right=None, join_columns=None) -> QueryBuilder:
        """A null-safe natural join with a private table. Tables without IDs are truncated on each side first."""
        right = QueryBuilder(right_operand) if isinstance(right_operand, str) else right_operand
        if not isinstance(right, QueryBuilder):
            raise TypeError("right_operand has to be a table's name or a QueryBuilder")
        return self._then(ir.JoinPrivate(self._node, right._node, truncation_strategy_left, truncation_strategy_right, None if join_columns is None else _columns(join_columns)))

    def replace_null_and_nan(self, replace_with: Mapping[str, Any] | None = None) -> QueryBuilder:
        return self._then(ir.ReplaceNullAndNan(self._node, tuple((replace_with or {}).items())))

    def replace_infinity(self, replace_with: Mapping[str, tuple[float, float]] | None = None) -> QueryBuilder:
        return self._then(ir.ReplaceInfinity(self._node, tuple((n, tuple(v)) for n, v in (replace_with or {}).items())))

    def drop_null_and_nan(self, columns=None) -> QueryBuilder:
        return self._then(ir.DropNullAndNan(self._node, _columns(columns)))

    def drop_infinity(self, columns=None) -> QueryBuilder:
        return self._then(ir.DropInfinity(self._node, _columns(columns)))

    def rename(self, column_mapper: Mapping[str, str]) -> QueryBuilder:
        if not column_mapper:
            raise ValueError("column_mapper may not be empty")
        return self._then(ir.Rename(self._node, tuple((_text(a, "a column name"), _text(b, "a column name")) for a, b in column_mapper.items())))

    def filter(self, condition: str) -> QueryBuilder:
        return self._then(ir.Filter(self._node, _text(condition, "the condition")))

    def select(self, columns) -> QueryBuilder:
        names = _columns(columns)
        if not names:
            raise ValueError("columns may not be empty")
        return self._then(ir.Select(self._node, names))

    def map(self, f: Callable, new_column_types: Mapping[str, ColumnDescriptor | ColumnType | str], augment: bool = False) -> QueryBuilder:
        return self._then(ir.Map(self._node, ir.Function(f), _new(new_column_types), augment))

    def flat_map(self, f: Callable, new_column_types, augment: bool = False, grouping: bool = False, max_rows: int | None = None) -> QueryBuilder:
        if max_rows is not None and (isinstance(max_rows, bool) or not isinstance(max_rows, int) or max_rows < 0):
            raise ValueError("max_rows has to be a whole number, not negative")
        return self._then(ir.FlatMap(self._node, ir.Function(f), _new(new_column_types), augment, grouping, max_rows))

    def flat_map_by_id(self, f: Callable, new_column_types) -> QueryBuilder:
        return self._then(ir.FlatMapByID(self._node, ir.Function(f), _new(new_column_types)))

    def bin_column(self, column: str, spec: BinningSpec, name: str | None = None) -> QueryBuilder:
        if not isinstance(spec, BinningSpec):
            raise TypeError("spec has to be a BinningSpec")
        return self._then(ir.Bin(self._node, _text(column, "column"), spec, name or f"{column}_binned"))

    def histogram(self, column: str, bin_edges, name: str | None = None) -> GroupbyCountQuery:
        """Counts by bin; values in no bin are left out."""
        spec = bin_edges if isinstance(bin_edges, BinningSpec) else BinningSpec(bin_edges)
        name = name or f"{column}_binned"
        return self.bin_column(column, spec, name).groupby(KeySet.from_dict({name: spec.bins()})).count()

    def enforce(self, constraint: Constraint) -> QueryBuilder:
        if not isinstance(constraint, Constraint):
            raise TypeError("constraint has to be a Constraint")
        return self._then(ir.Enforce(self._node, constraint))

    def get_groups(self, columns=None) -> Query:
        """Groups of columns that are safe to tell of."""
        return Query(ir.Aggregate(self._node, KeySet.from_dict({}), "get_groups", (), columns=_columns(columns) or None))

    def groupby(self, keys: KeySet | KeySetPlan | str | Iterable[str]) -> GroupedQueryBuilder:
        """Groups by the keys of a KeySet, or, where that feature is on, by columns or a plan whose keys are chosen privately."""
        if not isinstance(keys, KeySet):
            config.features.auto_partition_selection.require()
        if not isinstance(keys, (KeySet, KeySetPlan)):
            keys = _columns(keys)
            if not keys:
                raise ValueError("there has to be a column to group by")
        return GroupedQueryBuilder(self._node, keys)
