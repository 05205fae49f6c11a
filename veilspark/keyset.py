"""Sets of group keys: a small algebra, rewritten as it is built, and run as lazy DataFrames."""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import KEY_TYPES, ColumnDescriptor, ColumnType, coerce, infer, quoted

#: Rows of literal keys that are multiplied on the driver; larger products are cross joins.
IN_MEMORY = 1 << 16
#: Keys that are sent to every task of a join.
BROADCAST_KEYS = 100_000
_ARROW = {ColumnType.INTEGER: pa.int64(), ColumnType.VARCHAR: pa.string(), ColumnType.DATE: pa.date32()}


def spark_session() -> SparkSession:
    found = SparkSession.getActiveSession()
    return found if found is not None else SparkSession.builder.getOrCreate()


def null_safe(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left["`" + c + "`"].eqNullSafe(right["`" + c + "`"]) for c in columns), F.lit(True))


def join_keys(left: DataFrame, right: DataFrame, columns: list[str], how: str) -> DataFrame:
    """A null-safe join that keeps one copy of the join columns; left and right may share more columns only in semi and anti joins."""
    marked = right.select(*(quoted(c).alias(f"__right_{i}") if c in columns else quoted(c) for i, c in enumerate(right.columns)))
    pairs = [(c, f"__right_{right.columns.index(c)}") for c in columns]
    condition = reduce(lambda a, b: a & b, (quoted(c).eqNullSafe(F.col(m)) for c, m in pairs), F.lit(True))
    return left.join(marked, condition, how).drop(*(m for _, m in pairs))


class _Literal:
    """Rows given on the driver, each once."""

    def __init__(self, columns: Mapping[str, ColumnDescriptor], rows: list[tuple]):
        self.columns, self.rows = dict(columns), list(dict.fromkeys(rows))

    size_bound = property(lambda self: len(self.rows))
    nonempty = property(lambda self: bool(self.rows))

    def frame(self) -> DataFrame:
        schema = T.StructType([T.StructField(n, d.column_type.spark, d.allow_null) for n, d in self.columns.items()])
        table = pa.Table.from_arrays([pa.array([r[k] for r in self.rows], _ARROW[d.column_type]) for k, d in enumerate(self.columns.values())], names=list(self.columns))
        return spark_session().createDataFrame(table, schema)


class _Frame:
    def __init__(self, df: DataFrame):
        self.df, self.columns = df, infer(df)

    size_bound, nonempty = None, False

    def frame(self) -> DataFrame:
        return self.df.distinct()


class _Cross:
    """Disjoint factors, flat, with small literals multiplied already."""

    def __init__(self, factors: list):
        self.factors = factors
        self.columns = {n: d for f in factors for n, d in f.columns.items()}

    nonempty = property(lambda self: all(f.nonempty for f in self.factors))

    @property
    def size_bound(self):
        sizes = [f.size_bound for f in self.factors]
        return None if None in sizes else reduce(lambda a, b: a * b, sizes, 1)

    def frame(self) -> DataFrame:
        # the largest factor is streamed; Spark sends the others to its tasks where they are small
        sized = sorted(self.factors, key=lambda f: -(f.size_bound if f.size_bound is not None else 1 << 60))
        return reduce(lambda a, b: a.crossJoin(b), (f.frame() for f in sized))


class _Project:
    def __init__(self, child, names: list[str]):
        self.child, self.columns = child, {n: child.columns[n] for n in names}

    size_bound = property(lambda self: self.child.size_bound)
    nonempty = property(lambda self: self.child.nonempty)

    def frame(self) -> DataFrame:
        child = self.child.df if isinstance(self.child, _Frame) else self.child.frame()
        return child.select(*map(quoted, self.columns)).distinct()


class _Filter:
    def __init__(self, child, condition):
        self.child, self.condition, self.columns = child, condition, child.columns

    size_bound, nonempty = property(lambda self: self.child.size_bound), False

    def frame(self) -> DataFrame:
        return self.child.frame().where(self.condition)


class _Join:
    def __init__(self, left, right):
        self.left, self.right = left, right
        self.on = [n for n in left.columns if n in right.columns]
        self.columns = {n: _both(d, right.columns[n]) if n in self.on else d for n, d in left.columns.items()} | {n: d for n, d in right.columns.items() if n not in self.on}

    size_bound, nonempty = None, False

    def frame(self) -> DataFrame:
        return join_keys(self.left.frame(), self.right.frame(), self.on, "inner").select(*map(quoted, self.columns))


class _Subtract:
    def __init__(self, left, right):
        self.left, self.right, self.columns = left, right, left.columns

    size_bound, nonempty = property(lambda self: self.left.size_bound), False

    def frame(self) -> DataFrame:
        return join_keys(self.left.frame(), self.right.frame(), list(self.right.columns), "left_anti")


class _Union:
    def __init__(self, left, right):
        self.left, self.right = left, right
        self.columns = {n: ColumnDescriptor(d.column_type, d.allow_null or right.columns[n].allow_null) for n, d in left.columns.items()}

    nonempty = property(lambda self: self.left.nonempty or self.right.nonempty)

    @property
    def size_bound(self):
        a, b = self.left.size_bound, self.right.size_bound
        return None if a is None or b is None else a + b

    def frame(self) -> DataFrame:
        return self.left.frame().unionByName(self.right.frame()).distinct()


def _both(a: ColumnDescriptor, b: ColumnDescriptor) -> ColumnDescriptor:
    return ColumnDescriptor(a.column_type, a.allow_null and b.allow_null)


def _cross(parts: list):
    """Flattened, without factors of no columns, with small literals multiplied."""
    flat = [g for p in parts for g in (p.factors if isinstance(p, _Cross) else [p])]
    flat = [f for f in flat if f.columns]
    out: list = []
    for f in flat:
        last = next((i for i, o in enumerate(out) if isinstance(o, _Literal) and isinstance(f, _Literal) and len(o.rows) * len(f.rows) <= IN_MEMORY), None)
        if last is None:
            out.append(f)
        else:
            o = out[last]
            out[last] = _Literal(o.columns | f.columns, [a + b for a in o.rows for b in f.rows])
    if not out:
        return _Literal({}, [()])
    return out[0] if len(out) == 1 else _Cross(out)


def _project(op, names: list[str]):
    if list(op.columns) == names:
        return op
    if isinstance(op, _Project):
        return _project(op.child, names)
    if isinstance(op, _Literal):
        at = [list(op.columns).index(n) for n in names]
        return _Literal({n: op.columns[n] for n in names}, [tuple(r[i] for i in at) for r in op.rows])
    if isinstance(op, _Cross):
        kept = [_project(f, [n for n in f.columns if n in names]) if any(n in names for n in f.columns) else f for f in op.factors]
        # a factor none of whose columns are kept goes only if it surely has rows: nothing times it is nothing
        used = [f for f, o in zip(kept, op.factors) if any(n in names for n in o.columns) or not o.nonempty]
        small = _cross(used)
        if sorted(small.columns) == sorted(names):
            return small
        return _Project(small, names)
    return _Project(op, names)


def _parts(op, split: set) -> tuple[list, list]:
    """The factors of an operation, and what is subtracted from their product."""
    if isinstance(op, _Cross):
        both = [_parts(f, split) for f in op.factors]
    elif isinstance(op, _Subtract):
        both = [_parts(op.left, split), ([], [op.right])]
    elif isinstance(op, _Join) and set(op.on) <= split:
        both = [_parts(op.left, split), _parts(op.right, split)]
    else:
        return [op], []
    return [f for factors, _ in both for f in factors], [s for _, subtracted in both for s in subtracted]


def _paired(a, b) -> list[tuple] | None:
    """The factors of two operations by their columns; None if they have others."""
    left, right = ([*(op.factors if isinstance(op, _Cross) else [op])] for op in (a, b))
    by = {frozenset(f.columns): f for f in right}
    if len(left) != len(right) or {frozenset(f.columns) for f in left} != set(by):
        return None
    return [(f, by[frozenset(f.columns)]) for f in left]


def _same(a, b) -> bool:
    """Whether two operations surely have the same keys, as they are built alike; the order of columns and factors does not count."""
    if a is b:
        return True
    if isinstance(a, _Cross) or isinstance(b, _Cross):
        pairs = _paired(a, b)
        return bool(pairs) and all(_same(x, y) for x, y in pairs) if isinstance(a, _Cross) and isinstance(b, _Cross) else False
    if type(a) is not type(b) or set(a.columns) != set(b.columns):
        return False
    if isinstance(a, _Literal):
        return set(a.rows) == set(_project(b, list(a.columns)).rows)
    if isinstance(a, _Frame):
        return a.df is b.df or list(a.columns) == list(b.columns) and a.df.sameSemantics(b.df)
    if isinstance(a, _Project):
        return _same(a.child, b.child)
    if isinstance(a, _Filter):
        return isinstance(a.condition, str) and a.condition == b.condition and _same(a.child, b.child)
    if isinstance(a, (_Join, _Union)):
        return _same(a.left, b.left) and _same(a.right, b.right) or _same(a.left, b.right) and _same(a.right, b.left)
    return _same(a.left, b.left) and _same(a.right, b.right)


class KeySet:
    """An immutable set of group keys. Columns may be whole numbers, strings or dates, and may be null."""

    def __init__(self, op):
        self._op = op
        self._cached: DataFrame | None = None
        for name, d in op.columns.items():
            if d.column_type not in KEY_TYPES:
                raise ValueError(f"column {name!r} is {d.column_type}; group keys have to be {', '.join(sorted(map(str, KEY_TYPES)))}")

    @classmethod
    def from_dict(cls, domains: Mapping[str, Iterable]) -> KeySet:
        """Every combination of the columns' values; no columns at all stand for one group of all rows."""
        parts = [cls.from_tuples([(v,) for v in values], [name])._op for name, values in domains.items()]
        return cls(_cross(parts) if parts else _Literal({}, [()]))

    @classmethod
    def from_tuples(cls, tuples: Iterable[tuple], columns: list[str]) -> KeySet:
        rows = [tuple(t) for t in tuples]
        if not columns:
            if any(rows):
                raise ValueError("keys have values but no columns")
            return cls(_Literal({}, [()]))
        if any(not isinstance(c, str) or not c for c in columns) or len(set(columns)) != len(columns):
            raise ValueError("column names have to be strings, not empty, each once")
        if not rows:
            raise ValueError("there has to be a key to tell types from")
        if any(len(r) != len(columns) for r in rows):
            raise ValueError(f"every key has to have {len(columns)} values")
        out = {}
        for k, name in enumerate(columns):
            kinds = {type(r[k]) for r in rows if r[k] is not None}
            if len(kinds) != 1:
                raise ValueError(f"column {name!r} has {'no values' if not kinds else 'values of several types'}")
            kind = kinds.pop()
            found = {int: ColumnType.INTEGER, str: ColumnType.VARCHAR, datetime.date: ColumnType.DATE}.get(kind)
            if found is None:
                raise ValueError(f"column {name!r} has values of type {kind.__name__}, which can't be group keys")
            out[name] = ColumnDescriptor(found, any(r[k] is None for r in rows))
        return cls(_Literal(out, rows))

    @classmethod
    def from_dataframe(cls, dataframe: DataFrame) -> KeySet:
        return cls(_Frame(coerce(dataframe)) if dataframe.columns else _Literal({}, [()]))

    @classmethod
    def from_pandas(cls, dataframe) -> KeySet:
        plain = [tuple(None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in row) for row in dataframe.itertuples(index=False, name=None)]
        return cls.from_tuples(plain, list(map(str, dataframe.columns)))

    def columns(self) -> list[str]:
        return list(self._op.columns)

    def schema(self) -> dict[str, ColumnDescriptor]:
        return dict(self._op.columns)

    def size_bound(self) -> int | None:
        """A bound on the number of keys that needs no job, if there is one."""
        return self._op.size_bound

    def size(self) -> int:
        if isinstance(self._op, _Literal):
            return len(self._op.rows)
        if isinstance(self._op, _Cross):
            return reduce(lambda a, b: a * b, (KeySet(f).size() for f in self._op.factors))
        return self.dataframe().count()

    def dataframe(self) -> DataFrame:
        """The keys, each once. Without columns the frame is empty, though the set has one key."""
        if self._cached is not None:
            return self._cached
        if not self._op.columns:
            return spark_session().createDataFrame([], T.StructType([]))
        return self._op.frame().select(*map(quoted, self._op.columns))

    def to_pandas(self):
        return self.dataframe().toPandas()

    def cache(self) -> None:
        if self._cached is None and self._op.columns:
            self._cached = self.dataframe().persist()

    def uncache(self) -> None:
        if self._cached is not None:
            self._cached.unpersist()
            self._cached = None

    def __mul__(self, other: KeySet) -> KeySet:
        _keyset(other)
        shared = set(self.columns()) & set(other.columns())
        if shared:
            raise ValueError(f"both sides have {', '.join(sorted(shared))}; multiply sets of different columns or join them")
        return KeySet(_cross([self._op, other._op]))

    def __sub__(self, other: KeySet) -> KeySet:
        _keyset(other)
        if not other.columns() or set(other.columns()) - set(self.columns()):
            raise ValueError("the right side's columns have to be some of the left side's")
        self._same_types(other, other.columns())
        if isinstance(self._op, _Cross):  # only the factors that share columns are concerned
            touched = [f for f in self._op.factors if set(f.columns) & set(other.columns())]
            rest = [f for f in self._op.factors if not set(f.columns) & set(other.columns())]
            if rest:
                return KeySet(_cross([_Subtract(_cross(touched), other._op), *rest]))[self.columns()]
        return KeySet(_Subtract(self._op, other._op))

    def join(self, other: KeySet) -> KeySet:
        """The natural join; null matches null."""
        _keyset(other)
        on = [c for c in self.columns() if c in other.columns()]
        if not on:
            raise ValueError("no common columns to join on")
        self._same_types(other, on)
        if isinstance(self._op, _Cross):
            touched = [f for f in self._op.factors if set(f.columns) & set(on)]
            rest = [f for f in self._op.factors if not set(f.columns) & set(on)]
            if rest:
                order = [*self.columns(), *(c for c in other.columns() if c not in on)]
                return KeySet(_cross([_Join(_cross(touched), other._op), *rest]))[order]
        return KeySet(_Join(self._op, other._op))

    def union(self, other: KeySet) -> KeySet:
        _keyset(other)
        if set(self.columns()) != set(other.columns()):
            raise ValueError("both sides have to have the same columns")
        self._same_types(other, self.columns())
        return KeySet(_Union(self._op, other._op))

    def filter(self, condition: str | Column) -> KeySet:
        if isinstance(condition, str) and not condition.strip():
            raise ValueError("the condition is empty")
        found = KeySet(_Filter(self._op, condition))
        _Filter(_Literal(self._op.columns, []), condition).frame()  # has Spark analyse it
        return found

    def __getitem__(self, names) -> KeySet:
        names = [names] if isinstance(names, str) else list(names)
        missing = [n for n in names if n not in self._op.columns]
        if missing or not names or len(set(names)) != len(names):
            raise ValueError(f"not columns of this set, none, or some twice: {missing or names}")
        return KeySet(_project(self._op, names))

    def _same_types(self, other: KeySet, names) -> None:
        for n in names:
            a, b = self._op.columns[n].column_type, other._op.columns[n].column_type
            if a is not b:
                raise ValueError(f"column {n!r} is {a} on the left and {b} on the right")

    def decompose(self) -> list[KeySet]:
        """The factors whose product this is."""
        return [KeySet(f) for f in self._op.factors] if isinstance(self._op, _Cross) else [self]

    def decompose_with(self, split_columns: Iterable[str] = ()) -> tuple[list[KeySet], list[KeySet]]:
        """(factors, subtracted): the product of the factors less each of the subtracted sets is this set.

        Joins on split_columns alone are taken apart too; factors that share such columns are then to be joined instead.
        """
        names = list(split_columns)
        missing = [n for n in names if n not in self._op.columns]
        if missing:
            raise ValueError(f"not columns of this set: {missing}")
        factors, subtracted = _parts(self._op, set(names))
        return [KeySet(f) for f in factors], [KeySet(s) for s in subtracted]

    def is_equivalent(self, other) -> bool | None:
        """Whether both have the same keys, if that can be told without running a job; else None."""
        if not isinstance(other, KeySet):
            return False
        if {n: d.column_type for n, d in self._op.columns.items()} != {n: d.column_type for n, d in other._op.columns.items()}:
            return False
        if _same(self._op, other._op):
            return True
        if isinstance(self._op, _Literal) and isinstance(other._op, _Literal):
            return False
        pairs = _paired(self._op, other._op)
        # products of literals are the same only if every factor is, unless one is empty
        if pairs and all(isinstance(x, _Literal) and x.rows for pair in pairs for x in pair):
            return False
        return None

    def __eq__(self, other) -> bool:
        quick = self.is_equivalent(other)
        if quick is not None:
            return quick
        a, b = self.dataframe(), other.dataframe().select(*map(quoted, self.columns()))
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def __hash__(self) -> int:
        return hash(frozenset((n, d.column_type) for n, d in self._op.columns.items()))

    def __repr__(self) -> str:
        bound = self.size_bound()
        return f"KeySet({', '.join(f'{n}: {d.column_type}' for n, d in self._op.columns.items())}{'' if bound is None else f'; at most {bound} keys'})"


def _keyset(x) -> None:
    if not isinstance(x, KeySet):
        raise TypeError(f"a KeySet is wanted, not {type(x).__name__}")


class KeySetPlan:
    """Key sets of which some columns are to be found privately when the query runs.

    The detected columns become a KeySet then, and what was done to the plan is done to it.
    """

    def __init__(self, detected: tuple[str, ...], steps: tuple = (), columns: tuple[str, ...] | None = None):
        self.detected, self.steps = detected, steps
        self._columns = detected if columns is None else columns

    @classmethod
    def detect(cls, columns: Iterable[str]) -> KeySetPlan:
        names = tuple([columns] if isinstance(columns, str) else columns)
        if not names or len(set(names)) != len(names):
            raise ValueError("the columns to detect have to be some, each once")
        return cls(names)

    def columns(self) -> list[str]:
        return list(self._columns)

    def _then(self, step, columns) -> KeySetPlan:
        return KeySetPlan(self.detected, (*self.steps, step), tuple(columns))

    def __mul__(self, other: KeySet) -> KeySetPlan:
        _keyset(other)
        if set(self._columns) & set(other.columns()):
            raise ValueError("both sides have columns of one name")
        return self._then(lambda k: k * other, [*self._columns, *other.columns()])

    def __sub__(self, other: KeySet) -> KeySetPlan:
        _keyset(other)
        return self._then(lambda k: k - other, self._columns)

    def join(self, other: KeySet) -> KeySetPlan:
        _keyset(other)
        return self._then(lambda k: k.join(other), [*self._columns, *(c for c in other.columns() if c not in self._columns)])

    def union(self, other: KeySet) -> KeySetPlan:
        _keyset(other)
        return self._then(lambda k: k.union(other), self._columns)

    def filter(self, condition: str | Column) -> KeySetPlan:
        return self._then(lambda k: k.filter(condition), self._columns)

    def __getitem__(self, names) -> KeySetPlan:
        names = [names] if isinstance(names, str) else list(names)
        if set(names) - set(self._columns):
            raise ValueError(f"not columns of this plan: {sorted(set(names) - set(self._columns))}")
        return self._then(lambda k: k[names], names)

    def resolve(self, found: KeySet) -> KeySet:
        """The key set that the plan is with these detected keys."""
        return reduce(lambda k, step: step(k), self.steps, found)
