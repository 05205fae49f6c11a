"""Sessions: private tables behind a budget."""

from __future__ import annotations

import warnings
from fractions import Fraction
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .budget import ApproxDPBudget, PrivacyBudget, PureDPBudget, affordable, settle
from .keyset import KeySet, KeySetPlan
from .plans.answers import Answer, compile_answer
from .plans.tables import Scope, Table, compile_table
from .protect import MaxGroupsPerID, MaxRowsPerGroupPerID, MaxRowsPerID
from .query_builder import GroupedQueryBuilder, Query, QueryBuilder
from .sources.registry import Registry, check_id
from .sources.shipping import ship
from .types import ColumnDescriptor, ColumnType, Grouped, Ids, Rows, coerce, quoted


class Session:
    """Evaluates queries on private tables until the budget is spent.

    A session may be a part of another (partition_and_create). Parts are used one after another: the first use of a
    part ends those before it, and the next use of the whole ends all its parts.
    """

    class Builder(Registry):
        """Budget, tables and ID spaces of a session, in any order."""

        def build(self) -> Session:
            if self.budget is None:
                raise ValueError("a session needs a privacy budget")
            if not self.private:
                raise ValueError("a session needs a private table")
            return Session(self.budget, self.tables(), {n: coerce(df) for n, df in self.public.items()})

    def __init__(self, privacy_budget: PrivacyBudget, tables: dict[str, Table], public: dict[str, DataFrame]):
        self._remaining = privacy_budget
        for table in tables.values():
            ship(table.df.sparkSession)
        self._tables, self._public = dict(tables), public
        self._views: dict[str, Table] = {}
        self._cached: dict[str, DataFrame] = {}
        self._parent: Session | None = None
        self._children: list[Session] = []
        self._over: str | None = None

    @classmethod
    def from_dataframe(cls, privacy_budget, source_id: str, dataframe: DataFrame, protected_change) -> Session:
        return cls.Builder().with_privacy_budget(privacy_budget).with_private_dataframe(source_id, dataframe, protected_change).build()

    # ---- state

    def _activate(self) -> None:
        if self._over:
            raise RuntimeError(f"this session can't be used any more: {self._over}")
        if self._children:
            warnings.warn("using a session ends the sessions that were made by partitioning it", RuntimeWarning, stacklevel=3)
            for child in self._children:
                child._end("its parent was used again")
            self._children = []
        if self._parent is not None:
            siblings = self._parent._children
            for child in siblings[: siblings.index(self)]:
                child._end("a later part was used")
            del siblings[: siblings.index(self)]

    def _end(self, why: str) -> None:
        for child in self._children:
            child._end(why)
        self._children, self._over = [], why

    def stop(self) -> None:
        """Ends the session and its parts; cached views are released."""
        for view in list(self._cached):
            self._cached.pop(view).unpersist()
        self._end("it was stopped")

    # ---- what there is

    @property
    def private_sources(self) -> list[str]:
        return [*self._tables, *self._views]

    @property
    def public_sources(self) -> list[str]:
        return list(self._public)

    @property
    def public_source_dataframes(self) -> dict[str, DataFrame]:
        return dict(self._public)

    @property
    def remaining_privacy_budget(self) -> PrivacyBudget:
        return self._remaining

    def _scope(self) -> Scope:
        return Scope({**self._tables, **self._views}, self._public)

    def _table(self, source_id: str) -> Table:
        scope = self._scope()
        if source_id not in scope.private:
            raise KeyError(f"no private table named {source_id!r}")
        return scope.private[source_id]

    def get_schema(self, source_id: str) -> dict[str, ColumnDescriptor]:
        if source_id in self._public:
            from .types import infer

            return infer(self._public[source_id])
        return dict(self._table(source_id).meta.columns)

    def get_column_types(self, source_id: str) -> dict[str, ColumnType]:
        return {n: d.column_type for n, d in self.get_schema(source_id).items()}

    def get_grouping_column(self, source_id: str) -> str | None:
        return None if source_id in self._public else self._table(source_id).meta.grouping_column

    def get_id_column(self, source_id: str) -> str | None:
        return None if source_id in self._public else self._table(source_id).meta.id_column

    def get_id_space(self, source_id: str) -> str | None:
        metric = None if source_id in self._public else self._table(source_id).meta.metric
        return metric.space if isinstance(metric, Ids) else None

    # ---- tables

    def add_public_dataframe(self, source_id: str, dataframe: DataFrame) -> None:
        check_id(source_id)
        if source_id in self._public or source_id in self.private_sources:
            raise ValueError(f"there is a table {source_id!r} already")
        self._public[source_id] = coerce(dataframe)

    def create_view(self, query_expr: QueryBuilder, source_id: str, cache: bool) -> None:
        """Names what a builder gives, for later queries; it costs no budget and stays lazy unless cached."""
        self._activate()
        check_id(source_id)
        if not isinstance(query_expr, QueryBuilder):
            raise TypeError("a view is made from a QueryBuilder without an aggregation")
        if source_id in self._public or source_id in self.private_sources:
            raise ValueError(f"there is a table {source_id!r} already")
        table = compile_table(query_expr._node, self._scope())
        if cache:
            self._cached[source_id] = table.df.persist(StorageLevel.MEMORY_AND_DISK)
            table = Table(self._cached[source_id], table.meta)
        self._views[source_id] = table

    def delete_view(self, source_id: str) -> None:
        self._activate()
        if source_id not in self._views:
            raise KeyError(f"no view named {source_id!r}")
        del self._views[source_id]
        if source_id in self._cached:
            self._cached.pop(source_id).unpersist()

    # ---- budget

    def _request(self, privacy_budget: PrivacyBudget) -> PrivacyBudget:
        if isinstance(privacy_budget, PureDPBudget) and isinstance(self._remaining, ApproxDPBudget):
            privacy_budget = ApproxDPBudget(privacy_budget.amounts[0], 0)
        if type(privacy_budget) is not type(self._remaining):
            raise TypeError(f"the session has a {type(self._remaining).__name__}, not a {type(privacy_budget).__name__}")
        if privacy_budget.is_zero or privacy_budget.amounts[0] == 0:
            raise ValueError("a query needs a budget over zero")
        return settle(privacy_budget, self._remaining)

    def _spend(self, budget: PrivacyBudget) -> None:
        """Takes a budget before any data is read; it is not given back if the query then fails."""
        if not affordable(budget, self._remaining):
            short = ", ".join(f"{n}: {float(q):g} of {float(r):g} left" for n, q, r in zip(budget.names, budget.amounts, self._remaining.amounts) if not q <= r)
            raise RuntimeError(f"the query asks for more privacy budget than is left ({short})")
        self._remaining = self._remaining - budget

    def _compile(self, query: Query, privacy_budget: PrivacyBudget) -> tuple[Answer, PrivacyBudget]:
        if not isinstance(query, Query):
            raise TypeError("a query has to end with an aggregation" if isinstance(query, (QueryBuilder, GroupedQueryBuilder)) else "not a query")
        budget = self._request(privacy_budget)
        plan = query._plan
        answer = compile_answer(plan, self._scope(), budget)
        needs_delta = plan.kind == "get_groups" or not isinstance(plan.keys, KeySet)
        if isinstance(budget, ApproxDPBudget) and not needs_delta and not budget.is_infinite:
            budget = ApproxDPBudget(budget.amounts[0], 0)  # additive noise and the exponential mechanism use no delta
        return answer, budget

    def evaluate(self, query_expr: Query, privacy_budget: PrivacyBudget) -> DataFrame:
        """The answer, with noise that is drawn once, for a budget that is spent first."""
        self._activate()
        answer, budget = self._compile(query_expr, privacy_budget)
        self._spend(budget)
        return answer.run()

    def _noise_info(self, query_expr: Query, privacy_budget: PrivacyBudget) -> list[dict[str, Any]]:
        """Mechanisms and parameters of the noise that evaluate would add."""
        return [n.info() for n in self._compile(query_expr, privacy_budget)[0].noises]

    def _evaluate_with_noise_info(self, query_expr: Query, privacy_budget: PrivacyBudget):
        self._activate()
        answer, budget = self._compile(query_expr, privacy_budget)
        self._spend(budget)
        return answer.run(), [n.info() for n in answer.noises]

    def _spend_budget_without_executing(self, privacy_budget: PrivacyBudget) -> None:
        self._activate()
        self._spend(self._request(privacy_budget))

    # ---- parts

    def partition_and_create(self, source_id: str, privacy_budget: PrivacyBudget, column: str, splits: dict[str, Any]) -> dict[str, Session]:
        """Sessions of the rows with each of some values of a column; they cost their budget once, as no row is in two."""
        self._activate()
        budget = self._request(privacy_budget)
        if not splits:
            raise ValueError("there has to be a split")
        for name in splits:
            check_id(name)
        if len(set(splits.values())) != len(splits):
            raise ValueError("two splits have one value")
        t = self._table(source_id)
        t.meta.require([column])
        kind = t.meta.columns[column].column_type
        if kind not in (ColumnType.INTEGER, ColumnType.VARCHAR):
            raise ValueError(f"column {column!r} is {kind}; tables are split by whole numbers or strings")
        if any(not kind.accepts(v) for v in splits.values()):
            raise ValueError(f"the values of splits have to be {kind}, as column {column!r}")
        meta = t.meta
        if isinstance(meta.metric, Ids):
            groups = next((c.max for c in meta.constraints if isinstance(c, MaxGroupsPerID) and c.grouping_column == column), None)
            rows = next((c.max for c in meta.constraints if isinstance(c, MaxRowsPerID)), None)
            if groups is not None:
                # an ID is in at most so many parts, each of which hides whole IDs
                times = groups
                per_group = [MaxRowsPerID(c.max) for c in meta.constraints if isinstance(c, MaxRowsPerGroupPerID) and c.grouping_column == column]
                meta = meta.but(constraints=(*meta.constraints, *per_group))
            elif rows is not None:
                times, meta = 1, meta.but(metric=Rows(Fraction(rows)), id_column=None, constraints=())
            else:
                raise RuntimeError(f"to split a table with an ID column enforce MaxGroupsPerID of {column!r}, or MaxRowsPerID")
        elif isinstance(meta.metric, Grouped):
            if meta.metric.column == column:
                times, meta = meta.metric.groups, meta.but(metric=Rows(meta.metric.rows))
            else:
                times = 1
        else:
            times = 1
        if meta.id_column == column:
            raise ValueError("a table can't be split by its ID column")
        # parts that one change can all reach at once share their budget: evenly for epsilons, and for squares in zCDP
        own = budget if times == 1 or budget.is_infinite else budget / times
        self._spend(budget)
        out = {}
        for name, value in splits.items():
            child = Session(own, {name: Table(t.df.where(quoted(column) == F.lit(value)), meta.but(sources=frozenset({name})))}, self._public)
            child._parent = self
            out[name] = child
        self._children = list(out.values())
        return out

    # ---- description

    def describe(self, obj: Query | QueryBuilder | GroupedQueryBuilder | str | None = None) -> None:
        print(self._describe(obj))

    def _describe(self, obj=None) -> str:
        if obj is None:
            lines = [f"The session has a remaining privacy budget of {self._remaining}.", "Private tables:"]
            lines += [f"  {n}:\n{_shown(t)}" for n, t in self._scope().private.items()]
            if self._public:
                lines.append("Public tables:")
                lines += [f"  {n}: {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema.fields)}" for n, df in self._public.items()]
            return "\n".join(lines)
        if isinstance(obj, str):
            if obj in self._public:
                return f"public table {obj}: {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in self._public[obj].schema.fields)}"
            return f"{obj}:\n{_shown(self._table(obj))}"
        plan = obj._plan if isinstance(obj, Query) else None
        table = compile_table(plan.child if plan else obj._node, self._scope())
        lines = [f"{'Query' if plan else 'Table'}:", _shown(table)]
        keys = plan.keys if plan else getattr(obj, "_keys", None)
        if keys is not None and not isinstance(obj, QueryBuilder):
            private = keys if isinstance(keys, tuple) else tuple(keys.columns()) if isinstance(keys, KeySetPlan) else None
            size = f", {keys.size()} keys" if isinstance(keys, KeySet) and keys.columns() else ""
            lines.append(f"  grouped by {keys!r}{size}" if private is None else f"  grouped by {', '.join(private)}, chosen privately")
        if plan:
            lines.append(f"  {plan.kind} to {', '.join(plan.names)}")
        return "\n".join(lines)


def _shown(t: Table) -> str:
    width = max(map(len, t.meta.columns), default=0)
    lines = []
    for n, d in t.meta.columns.items():
        marks = [w for w, on in (("null", d.allow_null), ("NaN", d.allow_nan), ("inf", d.allow_inf)) if on]
        role = " ID" if n == t.meta.id_column else " grouping" if n == t.meta.grouping_column else ""
        lines.append(f"    {n:<{width}}  {d.column_type}{role}{' (' + ', '.join(marks) + ')' if marks else ''}")
    m = t.meta.metric
    hidden = f"{m.rows} rows" if isinstance(m, Rows) else f"{m.rows} rows in each of {m.groups} groups" if isinstance(m, Grouped) else f"all rows of an ID of space {m.space}"
    lines.append(f"    hides {hidden}" + "".join(f"; {c}" for c in t.meta.constraints))
    return "\n".join(lines)
