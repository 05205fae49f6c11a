"""Compiles table nodes to lazy DataFrames with their metadata; no data is touched but the keys of public tables."""

from __future__ import annotations

import datetime
import math
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, replace
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..keyset import join_keys
from ..protect import Constraint, MaxGroupsPerID, MaxRowsPerGroupPerID, MaxRowsPerID, simplify
from ..types import ColumnDescriptor, ColumnType, Grouped, Ids, Rows, TableMeta, coerce, infer, quoted
from . import ir

#: Rows that row functions made, after which a batch of them goes back to Spark.
OUT_ROWS = 20_000
#: What null and NaN become unless a value is given.
NULL_DEFAULTS = {
    ColumnType.INTEGER: 0,
    ColumnType.DECIMAL: 0.0,
    ColumnType.VARCHAR: "",
    ColumnType.DATE: datetime.date(1970, 1, 1),
    ColumnType.TIMESTAMP: datetime.datetime(1970, 1, 1),
}


@dataclass(frozen=True)
class Table:
    df: DataFrame
    meta: TableMeta


class Scope:
    """The tables that a plan may name. Private ones give a Table, public ones a DataFrame."""

    def __init__(self, private: Mapping[str, Table], public: Mapping[str, DataFrame]):
        self.private, self.public = private, public


def compile_table(node: ir.Node, scope: Scope) -> Table:
    return _COMPILERS[type(node)](node, scope)


def _with_rows(meta: TableMeta, factor) -> TableMeta:
    """The metadata after an operator makes up to factor rows of one."""
    m = meta.metric
    if isinstance(m, Rows):
        return meta.but(metric=Rows(m.rows * factor))
    if isinstance(m, Grouped):
        return meta.but(metric=replace(m, rows=m.rows * factor))
    return meta


def _source(node: ir.Source, scope: Scope) -> Table:
    if node.source_id in scope.private:
        return scope.private[node.source_id]
    if node.source_id in scope.public:
        raise ValueError(f"{node.source_id!r} is a public table; a query has to begin with a private one")
    raise ValueError(f"no table named {node.source_id!r}; there are {', '.join(map(repr, scope.private)) or 'none'}")


def _rename(node: ir.Rename, scope: Scope) -> Table:
    t = compile_table(node.child, scope)
    names = dict(node.names)
    t.meta.require(names)
    for old, new in names.items():
        if new in t.meta.columns:
            raise ValueError(f"can't rename {old!r} to {new!r}, which is a column already")
    if len(set(names.values())) != len(names):
        raise ValueError("two columns may not get one name")
    to = lambda n: names.get(n, n)
    m = t.meta.metric
    meta = t.meta.but(
        columns={to(n): d for n, d in t.meta.columns.items()},
        metric=replace(m, column=to(m.column)) if isinstance(m, Grouped) else m,
        id_column=to(t.meta.id_column),
        constraints=tuple(replace(c, grouping_column=to(c.grouping_column)) if hasattr(c, "grouping_column") else c for c in t.meta.constraints),
    )
    return Table(t.df.withColumnsRenamed(names), meta)


def _without_ansi(df: DataFrame, build):
    """Builds on a frame with errors of arithmetic as nulls: a query that fails on some rows would tell of them."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.ansi.enabled")
    conf.set("spark.sql.ansi.enabled", "false")
    try:
        return build()
    finally:
        conf.set("spark.sql.ansi.enabled", before)


#: Expressions, by the names of Spark's classes, that raise errors for some values even without ANSI mode, or run foreign code.
RAISING = frozenset(
    "RaiseError AssertTrue CallMethodViaReflection TryReflect Invoke StaticInvoke ScalaUDF PythonUDF PandasUDF SparkUDF HiveSimpleUDF HiveGenericUDF "
    "ElementAt ArrayInsert ArrayRepeat Sequence CreateMap MapFromArrays MapFromEntries MapConcat TransformKeys StringToMap "
    "ToNumber ToBinary ToCharacter AesEncrypt AesDecrypt Encode Decode StringDecode UnBase64 UrlDecode ParseUrl ParseJson FormatString "
    "JsonToStructs CsvToStructs XmlToStructs FromAvro SchemaOfJson SecondsToTimestamp MillisToTimestamp MicrosToTimestamp MakeInterval".split()
)


def _expressions(e):
    """An analysed expression and all below it."""
    yield e
    children = e.children()
    for k in range(children.size()):
        yield from _expressions(children.apply(k))


def _filter(node: ir.Filter, scope: Scope) -> Table:
    t = compile_table(node.child, scope)
    try:
        df = _without_ansi(t.df, lambda: t.df.filter(node.condition))
    except Exception as wrong:
        raise ValueError(f"the condition {node.condition!r} can't be analysed: {str(wrong).splitlines()[0]}") from None
    top = df._jdf.queryExecution().analyzed()
    condition = top.condition() if hasattr(top, "condition") and top.nodeName() == "Filter" else None
    if condition is not None:
        helper = df.sparkSession._jvm.org.apache.spark.sql.catalyst.expressions.SubqueryExpression
        if helper.hasSubquery(condition):
            raise ValueError("a condition may not hold a sub-query: it has to look at one row alone")
        if not condition.deterministic():
            raise ValueError("a condition has to be deterministic")
        raising = sorted({x.getClass().getSimpleName() for x in _expressions(condition)} & RAISING)
        if raising:
            raise ValueError(f"a condition may not use {', '.join(raising)}: an error on a private row would tell of it")
    return Table(df, t.meta)


def _kept_constraints(constraints, columns) -> tuple:
    return tuple(c for c in constraints if getattr(c, "grouping_column", None) is None or c.grouping_column in columns)


def _select(node: ir.Select, scope: Scope) -> Table:
    t = compile_table(node.child, scope)
    t.meta.require(node.columns)
    for needed, what in ((t.meta.id_column, "the ID column"), (t.meta.grouping_column, "the grouping column")):
        if needed is not None and needed not in node.columns:
            raise ValueError(f"{what} {needed!r} has to be selected too")
    meta = t.meta.but(columns={n: t.meta.columns[n] for n in node.columns}, constraints=_kept_constraints(t.meta.constraints, node.columns))
    return Table(t.df.select(*map(quoted, node.columns)), meta)


def _struct(columns) -> T.StructType:
    return T.StructType([T.StructField(n, d.column_type.spark, True) for n, d in columns])


def _taker(columns):
    """Checks a row that a function returns, and puts it in order."""
    names = [n for n, _ in columns]
    real = [k for k, (_, d) in enumerate(columns) if d.column_type is ColumnType.DECIMAL]
    strict = [k for k, (_, d) in enumerate(columns) if not d.allow_null]
    size = len(names)

    def take(row):
        if len(row) != size:
            raise ValueError("a row function returned other columns than it states")
        try:
            out = [row[n] for n in names]
        except KeyError:
            raise ValueError("a row function returned other columns than it states") from None
        for k in strict:
            if out[k] is None:
                raise ValueError("a row function returned null where none may be")
        for k in real:
            if out[k] is not None:
                out[k] = float(out[k])
        return out

    return take


def _naive(value):
    """A timestamp from Arrow as row functions see it: without a zone, in the worker's own."""
    return value.astimezone().replace(tzinfo=None) if value is not None and value.tzinfo is not None else value


def _applied(df: DataFrame, columns, kept: bool, per_row) -> DataFrame:
    """The rows that per_row gives for each row, after the row's own columns if kept. Rows go to Python in Arrow batches."""
    schema = T.StructType([*(df.schema.fields if kept else ()), *_struct(columns).fields])
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    made_times = {k for k, (_, d) in enumerate(columns) if d.column_type is ColumnType.TIMESTAMP}
    new_schema = _struct(columns)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = list(to_arrow_schema(new_schema).types)

        def built(batch, origins, rows):
            values = list(zip(*rows))
            for k in made_times:
                values[k] = [None if v is None else v.astimezone(datetime.timezone.utc) for v in values[k]]
            new = [pa.array(v, k) for v, k in zip(values, kinds)]
            own = batch.take(pa.array(origins, pa.int32())).columns if kept else []
            return pa.RecordBatch.from_arrays([*own, *new], names=schema.names)

        for batch in batches:
            origins, rows = [], []
            names, values = batch.schema.names, [c.to_pylist() for c in batch.columns]
            for k in (names.index(n) for n in times):
                values[k] = list(map(_naive, values[k]))
            for number, row in enumerate(zip(*values)):
                for made in per_row(dict(zip(names, row))):
                    origins.append(number)
                    rows.append(made)
                if len(rows) >= OUT_ROWS:
                    yield built(batch, origins, rows)
                    origins, rows = [], []
            if rows:
                yield built(batch, origins, rows)

    return df.mapInArrow(run, schema)


def _new_columns(t: Table, node, augment: bool) -> dict[str, ColumnDescriptor]:
    new = dict(node.new_columns)
    if "" in new:
        raise ValueError("a column name may not be empty")
    if not augment:
        return new
    both = set(new) & set(t.meta.columns)
    if both:
        raise ValueError(f"new columns {sorted(both)} are in the table already")
    return {**t.meta.columns, **new}


def _map(node: ir.Map, scope: Scope) -> Table:
    t = compile_table(node.child, scope)
    if not node.augment and (t.meta.id_column or t.meta.grouping_column):
        raise ValueError("a table with an ID or grouping column can only be mapped with augment=True")
    columns, f, take = _new_columns(t, node, node.augment), node.function.f, _taker(node.new_columns)
    df = _applied(t.df, node.new_columns, node.augment, lambda row: (take(f(row)),))
    return Table(df, t.meta.but(columns=columns, constraints=t.meta.constraints if node.augment else ()))


def _distinct_groups(rows):
    """The first of the rows that a function makes for each group."""
    seen = set()
    for row in rows:
        if row[0] not in seen:
            seen.add(row[0])
            yield row


def _flat_map(node: ir.FlatMap, scope: Scope) -> Table:
    t = compile_table(node.child, scope)
    ids = isinstance(t.meta.metric, Ids)
    if ids:
        if node.grouping:
            raise ValueError("a grouping flat map needs a table of rows, without an ID column")
        if node.max_rows is not None:
            warnings.warn("max_rows means nothing for a table with an ID column and is ignored", RuntimeWarning, stacklevel=3)
    elif node.max_rows is None:
        raise ValueError("max_rows is needed for a table without an ID column")
    if not node.augment and (t.meta.id_column or t.meta.grouping_column):
        raise ValueError("a table with an ID or grouping column can only be mapped with augment=True")
    if node.grouping and (t.meta.grouping_column or len(node.new_columns) != 1):
        raise ValueError("a grouping flat map makes one new column, of a table that has no grouping column yet")
    columns, f, take = _new_columns(t, node, node.augment), node.function.f, _taker(node.new_columns)
    most = None if ids else node.max_rows
    made = _distinct_groups if node.grouping else iter
    df = _applied(t.df, node.new_columns, node.augment, lambda row: islice(made(map(take, f(row))), most))
    if ids:
        meta = t.meta.but(constraints=tuple(c for c in t.meta.constraints if isinstance(c, MaxGroupsPerID)))
    elif node.grouping:
        # a row's new rows are in different groups, as repeats are left out, so a group gets one from each of the rows that differ
        meta = t.meta.but(metric=Grouped(node.new_columns[0][0], Fraction(node.max_rows), t.meta.metric.rows))
    else:
        meta = _with_rows(t.meta, node.max_rows)
    return Table(df, meta.but(columns=columns))


def _flat_map_by_id(node: ir.FlatMapByID, scope: Scope) -> Table:
    t = compile_table(node.child, scope)
    if not isinstance(t.meta.metric, Ids):
        raise ValueError("flat_map_by_id needs a table with an ID column")
    own = t.meta.id_column
    if own in dict(node.new_columns):
        raise ValueError(f"the ID column {own!r} is kept by itself and can't be a new one")
    f, take = node.function.f, _taker(node.new_columns)
    times = [f.name for f in t.df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    made_times = {k for k, (_, d) in enumerate(node.new_columns) if d.column_type is ColumnType.TIMESTAMP}
    schema = T.StructType([t.df.schema[own], *_struct(node.new_columns).fields])

    def of_id(table):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = list(to_arrow_schema(schema).types)
        names, values = table.schema.names, [c.to_pylist() for c in table.columns]
        for k in (names.index(n) for n in times):
            values[k] = list(map(_naive, values[k]))
        # in the order of their contents, so that the answer does not depend on how rows were dealt out
        rows = sorted(zip(*values), key=lambda row: [(v is None, v != v, v if v is not None and v == v else 0) for v in row])
        new = list(zip(*(take(r) for r in f([dict(zip(names, row)) for row in rows])))) or [()] * len(node.new_columns)
        for k in made_times:
            new[k] = [None if v is None else v.astimezone(datetime.timezone.utc) for v in new[k]]
        ids = [values[names.index(own)][0]] * len(new[0])
        if own in times:
            ids = [None if v is None else v.astimezone(datetime.timezone.utc) for v in ids]
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip([ids, *new], kinds)], names=schema.names)

    # an ID's rows are one call of the function, so they are one task's
    df = t.df.groupBy(quoted(own)).applyInArrow(of_id, schema)
    return Table(df, t.meta.but(columns={own: t.meta.columns[own], **dict(node.new_columns)}, constraints=()))


def _bin(node: ir.Bin, scope: Scope) -> Table:
    t = compile_table(node.child, scope)
    t.meta.require([node.column])
    if node.name in t.meta.columns:
        raise ValueError(f"there is a column {node.name!r} already")
    kind = t.meta.columns[node.column].column_type
    if kind is not node.spec.input_type and not (kind is ColumnType.DECIMAL and node.spec.input_type is ColumnType.INTEGER):
        raise ValueError(f"column {node.column!r} is {kind}, and the bins are of {node.spec.input_type}")
    df = t.df.select("*", node.spec.column(quoted(node.column)).alias(node.name))
    return Table(df, t.meta.but(columns={**t.meta.columns, node.name: node.spec.descriptor()}))


def _join_columns(left, right, given) -> list[str]:
    shared = [n for n in left if n in right]
    on = shared if given is None else list(given)
    if not on:
        raise ValueError("the tables have no column to join on" if given is None else "join_columns may not be empty")
    if len(set(on)) != len(on):
        raise ValueError("a join column is named twice")
    for n in on:
        if n not in shared:
            raise ValueError(f"join column {n!r} is not in both tables")
        if left[n].column_type is not right[n].column_type:
            raise ValueError(f"join column {n!r} is {left[n].column_type} on the left and {right[n].column_type} on the right")
    return on


def _joined(left: DataFrame, right: DataFrame, a, b, on: list[str], how: str):
    """(frame, descriptors) of a null-safe natural join: join columns, those of the left, those of the right, and shared others with suffixes."""
    shared = [n for n in a if n in b and n not in on]
    to_left, to_right = {n: f"{n}_left" for n in shared}, {n: f"{n}_right" for n in shared}
    taken = (set(a) | set(b)) - set(shared)
    clash = [n for n in [*to_left.values(), *to_right.values()] if n in taken]
    if clash:
        raise ValueError(f"the joined table would have columns {clash} twice")
    df = join_keys(left.withColumnsRenamed(to_left), right.withColumnsRenamed(to_right), on, how)
    every = how == "left"

    def merged(n):
        x, y = a[n], b[n]
        return x if every else ColumnDescriptor(x.column_type, x.allow_null and y.allow_null, x.allow_nan and y.allow_nan, x.allow_inf and y.allow_inf)

    def loose(d):
        return replace(d, allow_null=True) if every else d

    columns = {n: merged(n) for n in on}
    columns |= {n: d for n, d in a.items() if n not in on and n not in shared}
    columns |= {n: loose(d) for n, d in b.items() if n not in on and n not in shared}
    for n in shared:
        columns |= {to_left[n]: a[n], to_right[n]: loose(b[n])}
    return df.select(*map(quoted, columns)), columns, to_left, to_right


def _renamed_constraint(c: Constraint, names: dict) -> Constraint:
    return replace(c, grouping_column=names.get(c.grouping_column, c.grouping_column)) if hasattr(c, "grouping_column") else c


def _multiplied(constraints, factor, names) -> list[Constraint]:
    """A side's constraints when each of its rows meets up to factor others; without a bound, those of groups alone stay."""
    out = []
    for c in constraints:
        c = _renamed_constraint(c, names)
        if isinstance(c, MaxGroupsPerID):
            out.append(c)
        elif factor:
            out.append(replace(c, max=c.max * factor))
    return out


def _join_private(node: ir.JoinPrivate, scope: Scope) -> Table:
    left, right = compile_table(node.child, scope), compile_table(node.right, scope)
    on = _join_columns(left.meta.columns, right.meta.columns, node.columns)
    ids = isinstance(left.meta.metric, Ids)
    if ids != isinstance(right.meta.metric, Ids):
        raise ValueError("a table with an ID column can only be joined with another one")
    if ids:
        if left.meta.metric.space != right.meta.metric.space:
            raise ValueError("the tables are in different ID spaces")
        if left.meta.id_column != right.meta.id_column or left.meta.id_column not in on:
            raise ValueError("the ID columns have to have one name and to be joined on")
        if node.left_strategy or node.right_strategy:
            warnings.warn("truncation strategies mean nothing for tables with ID columns and are ignored", RuntimeWarning, stacklevel=3)
        df, columns, to_left, to_right = _joined(left.df, right.df, left.meta.columns, right.meta.columns, on, "inner")
        per_id = [next((c.max for c in side.meta.constraints if isinstance(c, MaxRowsPerID)), None) for side in (left, right)]
        constraints = simplify(_multiplied(left.meta.constraints, per_id[1], to_left) + _multiplied(right.meta.constraints, per_id[0], to_right))
        return Table(df, TableMeta(columns, left.meta.metric, left.meta.id_column, constraints, left.meta.sources | right.meta.sources))
    if node.left_strategy is None or node.right_strategy is None:
        raise ValueError("truncation strategies are needed for both sides, which have no ID column")
    df, columns, _, _ = _joined(node.left_strategy.apply(left.df, on), node.right_strategy.apply(right.df, on), left.meta.columns, right.meta.columns, on, "inner")
    a, b, m, n = node.left_strategy, node.right_strategy, _total(left.meta), _total(right.meta)
    return Table(df, TableMeta(columns, Rows(a.max_rows * b.stability * n + b.max_rows * a.stability * m), sources=left.meta.sources | right.meta.sources))


def _total(meta: TableMeta) -> Fraction:
    m = meta.metric
    return m.rows if isinstance(m, Rows) else m.groups * m.rows


def _multiplicity(public: DataFrame, on: list[str]) -> int:
    """Most rows of a key. The table is public, so its keys may be looked at; once for each table and key."""
    known = public.__dict__.setdefault("_veilspark_multiplicity", {})
    key = tuple(sorted(on))
    if key not in known:
        known[key] = public.groupBy(*map(quoted, on)).count().agg(F.max("count")).first()[0] or 0
    return known[key]


def _join_public(node: ir.JoinPublic, scope: Scope) -> Table:
    t = compile_table(node.child, scope)
    if isinstance(node.public, str):
        if node.public not in scope.public:
            raise ValueError(f"no public table named {node.public!r}")
        public = scope.public[node.public]
    else:
        public = coerce(node.public)
    if node.how not in ("inner", "left"):
        raise ValueError("a public join is inner or left")
    theirs = infer(public)
    on = _join_columns(t.meta.columns, theirs, node.columns)
    df, columns, to_left, _ = _joined(t.df, public, t.meta.columns, theirs, on, node.how)
    for own in (t.meta.id_column, t.meta.grouping_column):
        if own in to_left:
            raise ValueError(f"column {own!r} marks IDs or groups, so it has to be joined on or be in one table only")
    most = _multiplicity(public, on)
    if node.how == "left":
        most = max(1, most)
    constraints = simplify(_multiplied(t.meta.constraints, most, to_left))
    return Table(df, _with_rows(t.meta.but(columns=columns, constraints=constraints), most))


def _special_columns(meta: TableMeta, given, fits) -> list[str]:
    """The columns that a special value operator changes: those given, or all that may need it but for IDs and groups."""
    own = {meta.id_column, meta.grouping_column}
    if not given:
        return [n for n, d in meta.columns.items() if n not in own and fits(d)]
    meta.require(given)
    if meta.grouping_column in given:
        raise ValueError("values of the grouping column can't be replaced or dropped")
    return list(given)


def _missing(n: str, d: ColumnDescriptor):
    c = quoted(n)
    return c.isNull() | F.isnan(c) if d.column_type is ColumnType.DECIMAL else c.isNull()


def _replace_null(node: ir.ReplaceNullAndNan, scope: Scope) -> Table:
    t = compile_table(node.child, scope)
    values = dict(node.values)
    if not values and t.meta.id_column:
        warnings.warn(f"null IDs in {t.meta.id_column!r} are not replaced unless the column is named", RuntimeWarning, stacklevel=3)
    names = _special_columns(t.meta, values, lambda d: d.special)
    out, columns = [], dict(t.meta.columns)
    for n in names:
        kind = columns[n].column_type
        value = values.get(n, NULL_DEFAULTS[kind])
        if value is None or (isinstance(value, float) and not math.isfinite(value)) or not kind.accepts(value):
            raise ValueError(f"{value!r} can't replace null in {kind} column {n!r}")
    if t.meta.id_column in names and any(isinstance(c, Constraint) for c in t.meta.constraints):
        constraints: tuple = ()  # two IDs may become one
    else:
        constraints = tuple(c for c in t.meta.constraints if not (isinstance(c, MaxRowsPerGroupPerID) and c.grouping_column in names))
    for n in t.df.columns:
        if n in names:
            value = values.get(n, NULL_DEFAULTS[columns[n].column_type])
            out.append(F.when(_missing(n, columns[n]), F.lit(value).cast(columns[n].column_type.spark)).otherwise(quoted(n)).alias(n))
            columns[n] = replace(columns[n], allow_null=False, allow_nan=False)
        else:
            out.append(quoted(n))
    return Table(t.df.select(*out), t.meta.but(columns=columns, constraints=constraints))


def _replace_infinity(node: ir.ReplaceInfinity, scope: Scope) -> Table:
    t = compile_table(node.child, scope)
    values = dict(node.values)
    names = _special_columns(t.meta, values, lambda d: d.allow_inf)
    out, columns = [], dict(t.meta.columns)
    for n in names:
        if columns[n].column_type is not ColumnType.DECIMAL:
            raise ValueError(f"column {n!r} is {columns[n].column_type}; only DECIMAL columns hold infinities")
        if len(values.get(n, (0, 0))) != 2 or not all(isinstance(v, (int, float)) and math.isfinite(v) for v in values.get(n, (0, 0))):
            raise ValueError(f"column {n!r} needs two finite numbers, for -inf and for inf")
    for n in t.df.columns:
        if n in names:
            low, high = values.get(n, (0.0, 0.0))
            c = quoted(n)
            out.append(F.when(c == -math.inf, F.lit(float(low))).when(c == math.inf, F.lit(float(high))).otherwise(c).alias(n))
            columns[n] = replace(columns[n], allow_inf=False)
        else:
            out.append(quoted(n))
    constraints = tuple(c for c in t.meta.constraints if not (isinstance(c, MaxRowsPerGroupPerID) and c.grouping_column in names))
    return Table(t.df.select(*out), t.meta.but(columns=columns, constraints=constraints))


def _drop_null(node: ir.DropNullAndNan, scope: Scope) -> Table:
    t = compile_table(node.child, scope)
    if not node.columns and t.meta.id_column:
        warnings.warn(f"rows with null in the ID column {t.meta.id_column!r} stay unless the column is named", RuntimeWarning, stacklevel=3)
    df, columns = t.df, dict(t.meta.columns)
    for n in _special_columns(t.meta, node.columns, lambda d: d.special):
        df = df.where(~_missing(n, columns[n]))
        columns[n] = replace(columns[n], allow_null=False, allow_nan=False)
    return Table(df, t.meta.but(columns=columns))


def _drop_infinity(node: ir.DropInfinity, scope: Scope) -> Table:
    t = compile_table(node.child, scope)
    df, columns = t.df, dict(t.meta.columns)
    for n in _special_columns(t.meta, node.columns, lambda d: d.allow_inf):
        if columns[n].column_type is not ColumnType.DECIMAL:
            raise ValueError(f"column {n!r} is {columns[n].column_type}; only DECIMAL columns hold infinities")
        df = df.where(quoted(n).isNull() | (F.abs(quoted(n)) != math.inf) | F.isnan(quoted(n)))
        columns[n] = replace(columns[n], allow_inf=False)
    return Table(df, t.meta.but(columns=columns))


def _enforce(node: ir.Enforce, scope: Scope) -> Table:
    t = compile_table(node.child, scope)
    if not isinstance(t.meta.metric, Ids):
        raise ValueError("constraints need a table with an ID column")
    column = getattr(node.constraint, "grouping_column", None)
    if column is not None:
        t.meta.require([column])
        if column == t.meta.id_column:
            raise ValueError("the ID column can't be the constraint's grouping column")
    return Table(node.constraint.enforce(t.df, t.meta.id_column), t.meta.but(constraints=simplify([*t.meta.constraints, node.constraint])))


_COMPILERS = {
    ir.Source: _source,
    ir.Rename: _rename,
    ir.Filter: _filter,
    ir.Select: _select,
    ir.Map: _map,
    ir.FlatMap: _flat_map,
    ir.FlatMapByID: _flat_map_by_id,
    ir.Bin: _bin,
    ir.JoinPrivate: _join_private,
    ir.JoinPublic: _join_public,
    ir.ReplaceNullAndNan: _replace_null,
    ir.ReplaceInfinity: _replace_infinity,
    ir.DropNullAndNan: _drop_null,
    ir.DropInfinity: _drop_infinity,
    ir.Enforce: _enforce,
}
