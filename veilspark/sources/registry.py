"""Collects budget, tables and ID spaces, each once."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame

from ..plans.tables import Table
from ..protect import AddMaxRows, AddMaxRowsInMaxGroups, AddRowsWithID, ProtectedChange
from ..types import KEY_TYPES, Grouped, Ids, Rows, TableMeta, coerce, infer


def check_id(source_id) -> None:
    if not isinstance(source_id, str) or not source_id.isidentifier():
        raise ValueError(f"{source_id!r} can't name a table: an identifier is wanted")


class Registry:
    """The parts of a session to be; with_parameter keeps further settings by name."""

    def __init__(self):
        self.budget = None
        self.private: dict[str, tuple[DataFrame, ProtectedChange]] = {}
        self.public: dict[str, DataFrame] = {}
        self.spaces: set[str] = set()
        self.parameters: dict = {}

    def with_parameter(self, name: str, value):
        if name in self.parameters:
            raise ValueError(f"parameter {name!r} is set already")
        self.parameters[name] = value
        return self

    def with_privacy_budget(self, privacy_budget):
        if self.budget is not None:
            raise ValueError("the privacy budget is set already")
        self.budget = privacy_budget
        return self

    def _free(self, source_id) -> None:
        check_id(source_id)
        if source_id in self.private or source_id in self.public:
            raise ValueError(f"there is a table {source_id!r} already")

    def with_private_dataframe(self, source_id: str, dataframe: DataFrame, protected_change: ProtectedChange):
        self._free(source_id)
        if not isinstance(protected_change, ProtectedChange):
            raise TypeError("protected_change has to be a ProtectedChange")
        self.private[source_id] = (dataframe, protected_change)
        return self

    def with_public_dataframe(self, source_id: str, dataframe: DataFrame):
        self._free(source_id)
        self.public[source_id] = dataframe
        return self

    def with_id_space(self, id_space: str):
        if id_space in self.spaces:
            raise ValueError(f"there is an ID space {id_space!r} already")
        self.spaces.add(id_space)
        return self

    def tables(self) -> dict[str, Table]:
        out = {}
        for name, (df, change) in self.private.items():
            df = coerce(df)
            columns = infer(df)
            if isinstance(change, AddMaxRows):
                meta = TableMeta(columns, Rows(Fraction(change.max_rows)))
            elif isinstance(change, AddMaxRowsInMaxGroups):
                meta = TableMeta(columns, Grouped(change.grouping_column, Fraction(change.max_groups), Fraction(change.max_rows_per_group)))
                meta.require([change.grouping_column])
                if columns[change.grouping_column].column_type not in KEY_TYPES:
                    raise ValueError(f"column {change.grouping_column!r} of {name!r} can't be grouped by")
            elif isinstance(change, AddRowsWithID):
                if change.id_space not in self.spaces:
                    if len(self.private) > 1:
                        raise ValueError(f"table {name!r} names the ID space {change.id_space!r}, which is not declared")
                    self.spaces.add(change.id_space)
                meta = TableMeta(columns, Ids(change.id_space), change.id_column)
                meta.require([change.id_column])
                if columns[change.id_column].column_type not in KEY_TYPES:
                    raise ValueError(f"column {change.id_column!r} of {name!r} is {columns[change.id_column].column_type}, which can't hold IDs")
            else:
                raise TypeError(f"unknown protected change {type(change).__name__}")
            out[name] = Table(df, meta.but(sources=frozenset({name})))
        # where one ID column of a space may be null, all may
        for space in self.spaces:
            within = [n for n, t in out.items() if t.meta.metric == Ids(space)]
            if any(out[n].meta.columns[out[n].meta.id_column].allow_null for n in within):
                for n in within:
                    meta = out[n].meta
                    d = meta.columns[meta.id_column]
                    out[n] = Table(out[n].df, meta.but(columns={**meta.columns, meta.id_column: type(d)(d.column_type, True)}))
        return out
