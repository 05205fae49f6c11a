"""Aggregations: sensitivity, noise, and the exact parts that Spark computes.

An answer's exact parts are one lazy DataFrame with a row for each key. With an infinite budget the answer is that
frame, finished by Spark's own functions. Else each row gets its draws exactly once and the frame is fixed: small key
sets on the driver, others in a table, so that no later action draws again.
"""

from __future__ import annotations

import math
import uuid
import warnings
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..budget import ApproxDPBudget, PrivacyBudget, RhoZCDPBudget
from ..keyset import BROADCAST_KEYS, KeySet, KeySetPlan, join_keys, spark_session
from ..operators.noise import Noise, NoiseMechanism, discrete_laplace, gumbel, root_below, uniform
from ..protect import MaxGroupsPerID, MaxRowsPerGroupPerID, MaxRowsPerID
from ..sources.shipping import ship
from ..types import NUMERIC, ColumnType, Grouped, Ids, Rows, quoted
from . import ir
from .tables import Scope, Table, compile_table

#: Keys up to which an answer is fixed on the driver.
ON_DRIVER = 10_000
#: Bits of a value's place between the bounds of a quantile, as many as doubles tell apart there; and of the blocks that values are ranked in.
PLACE, BLOCK = 50, 12
#: The part of a group's values that bounds have to hold.
INSIDE = 0.95
#: Exponents of two that bounds are searched among.
EXPONENTS = {ColumnType.INTEGER: range(0, 64), ColumnType.DECIMAL: range(-100, 101)}
NUMERIC_KINDS = ("sum", "average", "variance", "stdev")
#: Whole numbers within this size are summed as longs, which no table is long enough to overflow; others as decimals.
LONG_SAFE = 1 << 20


@dataclass(frozen=True)
class Part:
    """A sum over rows: its Spark aggregate, whether it is whole, how far one row moves it, and what it sums."""

    column: object
    whole: bool
    per_row: Fraction
    value: object = None

    def under(self, noise: Noise):
        """The aggregate that noise is added to: of whole steps of its grid, if it has one."""
        if noise.grid is None:
            return self.column
        step = float(noise.grid)
        return _summed(F.rint(self.value / F.lit(step)).cast("long"), True, self.per_row / noise.grid)


@dataclass(frozen=True)
class Answer:
    """A compiled query; run() gives its DataFrame."""

    run: object
    noises: tuple[Noise, ...]
    keys: KeySet | None


# ---- sensitivity


def bounded(t: Table, grouping: list[str], zcdp: bool) -> Table:
    """An ID table as one of rows, by the constraints that allow the least noise. They hold of the data already."""
    if not isinstance(t.meta.metric, Ids):
        return t
    options = []
    by = {(type(c), getattr(c, "grouping_column", None)): c.max for c in t.meta.constraints}
    for (kind, column), most in by.items():
        if kind is MaxRowsPerID:
            options.append((Fraction(most) ** 2, Rows(Fraction(most))))
        if kind is MaxGroupsPerID and (MaxRowsPerGroupPerID, column) in by:
            rows = by[MaxRowsPerGroupPerID, column]
            if zcdp and column in grouping:
                options.append((Fraction(most) * rows**2, Grouped(column, Fraction(most), Fraction(rows))))
            else:
                options.append((Fraction(most * rows) ** 2, Rows(Fraction(most * rows))))
    if not options:
        raise RuntimeError(
            "a table with an ID column needs bounds on what an ID contributes before it is aggregated: enforce MaxRowsPerID, or MaxGroupsPerID and MaxRowsPerGroupPerID of one column"
        )
    return Table(t.df, t.meta.but(metric=min(options, key=lambda o: o[0])[1]))


def _l1(metric) -> Fraction:
    return metric.rows if isinstance(metric, Rows) else metric.groups * metric.rows


def _l2_squared(metric, grouping) -> Fraction:
    if isinstance(metric, Grouped) and metric.column in grouping:
        return metric.groups * metric.rows**2
    return _l1(metric) ** 2


def noise_for(part: Part, metric, grouping, budget: PrivacyBudget, share: int, gaussian: bool) -> Noise:
    """The noise of one of share parts that split a budget evenly."""
    if gaussian:
        kind = NoiseMechanism.DISCRETE_GAUSSIAN if part.whole else NoiseMechanism.GAUSSIAN
        rho = budget.amounts[0]
        return Noise(kind, Fraction(0) if budget.is_infinite else part.per_row**2 * _l2_squared(metric, grouping) * share / (2 * rho), part.per_row)
    kind = NoiseMechanism.GEOMETRIC if part.whole else NoiseMechanism.LAPLACE
    if budget.is_infinite:
        return Noise(kind, Fraction(0))
    epsilon = budget.amounts[0] / share
    if isinstance(budget, RhoZCDPBudget):  # epsilon-DP is epsilon^2 / 2 zCDP
        epsilon = root_below(2 * epsilon)
    return Noise(kind, part.per_row * _l1(metric) / epsilon, part.per_row)


def _gaussian(mechanism: str, budget: PrivacyBudget) -> bool:
    if mechanism not in ("default", "laplace", "gaussian"):
        raise ValueError(f"unknown mechanism {mechanism!r}")
    zcdp = isinstance(budget, RhoZCDPBudget)
    if mechanism == "gaussian" and not zcdp:
        raise ValueError("Gaussian noise needs a zCDP budget")
    return zcdp and mechanism != "laplace"


def additive(budget: PrivacyBudget, mechanism: str) -> PrivacyBudget:
    """What additive noise takes of a budget: delta is of no use to it."""
    if isinstance(budget, ApproxDPBudget) and not budget.is_infinite and budget.amounts[1] and mechanism == "laplace":
        warnings.warn("Laplace noise does not use delta; it stays unspent", RuntimeWarning, stacklevel=4)
    return budget


# ---- keys


def _check_keys(meta, keys: KeySet) -> list[str]:
    schema = keys.schema()
    meta.require(schema)
    for n, d in schema.items():
        if meta.columns[n].column_type is not d.column_type:
            raise ValueError(f"key column {n!r} is {d.column_type}, and {meta.columns[n].column_type} in the table")
    return [n for n in meta.columns if n in schema]


def _own_group(meta, grouping) -> None:
    if meta.grouping_column is not None and meta.grouping_column not in grouping:
        raise ValueError(f"the query has to be grouped by {meta.grouping_column!r}, whose groups its sensitivity counts")


def _small(keys: KeySet) -> bool:
    bound = keys.size_bound()
    return bound is not None and bound <= BROADCAST_KEYS


def _key_frame(keys: KeySet) -> DataFrame:
    return F.broadcast(keys.dataframe()) if _small(keys) else keys.dataframe()


def per_key(df: DataFrame, keys: KeySet, grouping: list[str], aggregates: dict) -> DataFrame:
    """Aggregates for every key and no other, null where a key has no rows. Rows of other keys go before the shuffle."""
    columns = [a.alias(n) for n, a in aggregates.items()]
    if not grouping:
        return df.agg(*columns)
    kept = join_keys(df, _key_frame(keys), grouping, "left_semi")
    found = kept.groupBy(*map(quoted, grouping)).agg(*columns)
    return join_keys(keys.dataframe(), found, grouping, "left").select(*map(quoted, grouping), *aggregates)


# ---- fixing draws


SCRATCH: list[str] = []


def _folder(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/veilspark-answers-{spark.sparkContext.applicationId}"


def fix(df: DataFrame, keys: KeySet | None, schema: T.StructType, finish) -> DataFrame:
    """Rows that finish gives for the rows of df (none for None), drawn once. finish takes and returns tuples."""
    spark = spark_session()
    bound = 1 if keys is not None and not keys.columns() else None if keys is None else keys.size_bound()
    if bound is not None and bound <= ON_DRIVER:
        rows = [r for r in map(finish, map(tuple, df.collect())) if r is not None]
        return spark.createDataFrame(rows, schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = [r for r in map(finish, zip(*(c.to_pylist() for c in batch.columns))) if r is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    SCRATCH.append(path)
    df.mapInArrow(run, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _schema(meta, grouping, outputs: dict) -> T.StructType:
    keys = [T.StructField(n, meta.columns[n].column_type.spark, True) for n in grouping]
    return T.StructType(keys + [T.StructField(n, t, True) for n, t in outputs.items()])


# ---- parts of each aggregation


def _half(x: Fraction | float):
    return x if isinstance(x, Fraction) else Fraction(x)


def _summed(x, whole: bool, size):
    if not whole:
        return F.sum(x)
    return F.sum(x) if size <= LONG_SAFE else F.sum(x.cast("decimal(38,0)")).cast("long")


def _clamped(agg: ir.Aggregate, kind: ColumnType):
    low, high = agg.low, agg.high
    if kind is ColumnType.INTEGER:
        low, high = math.ceil(low), math.floor(high)
    t = kind.spark
    x = quoted(agg.column)
    return F.least(F.greatest(x, F.lit(low).cast(t)), F.lit(high).cast(t)), _half(low), _half(high)


def recipe(agg: ir.Aggregate, kind: ColumnType | None):
    """(parts, native finish from columns, finish from numbers, output type)."""
    one = Part(F.count(F.lit(1)), True, Fraction(1))
    if agg.kind in ("count", "count_distinct"):
        return [one], lambda c: F.coalesce(c[0], F.lit(0)).cast("long"), lambda v: int(v[0] or 0), T.LongType()
    x, low, high = _clamped(agg, kind)
    whole = kind is ColumnType.INTEGER
    size = max(abs(low), abs(high))
    if agg.kind == "sum":
        out = kind.spark
        return (
            [Part(_summed(x, whole, size), whole, size, x)],
            lambda c: F.coalesce(c[0], F.lit(0)).cast(out),
            lambda v: int(v[0] or 0) if whole else float(v[0] or 0.0),
            out,
        )
    middle = Fraction(math.ceil((low + high) / 2)) if whole else (low + high) / 2
    mid = F.lit(int(middle)).cast("long") if whole else F.lit(float(middle))
    off = max(high - middle, middle - low)
    first = Part(_summed(x - mid, whole, off), whole, off, x - mid)
    if agg.kind == "average":

        def average(v):
            return float(v[0] or 0) / max(1, v[1] or 0) + float(middle)

        return [first, one], lambda c: F.coalesce(c[0] / F.greatest(c[1], F.lit(1)), F.lit(0.0)) + F.lit(float(middle)), average, T.DoubleType()
    second = Part(_summed((x - mid) * (x - mid), whole, off**2), whole, off**2, (x - mid) * (x - mid))
    root = agg.kind == "stdev"

    def spread(v):
        n = v[0] or 0
        if n < 2:
            return math.nan
        s, ss = float(v[1] or 0), float(v[2] or 0)
        most = float((high - low) ** 2 / 4) * n / (n - 1)
        var = min(max((ss - s * s / n) / (n - 1), 0.0), most)
        return math.sqrt(var) if root else var

    return [one, first, second], None, spread, T.DoubleType()


def _prepared(agg: ir.Aggregate, scope: Scope) -> Table:
    """The table, without null and NaN in a measured column; get_bounds looks at no infinities either, others clamp them."""
    t = compile_table(agg.child, scope)
    if agg.column is None:
        return t
    t.meta.require([agg.column])
    d = t.meta.columns[agg.column]
    if d.column_type not in NUMERIC:
        raise ValueError(f"column {agg.column!r} is {d.column_type}; {agg.kind} needs numbers")
    if agg.column == t.meta.id_column:
        raise ValueError(f"column {agg.column!r} holds IDs, which can't be measured")
    x, df = quoted(agg.column), t.df
    if d.allow_null:
        df = df.where(x.isNotNull())
    if d.allow_nan:
        df = df.where(~F.isnan(x))
    if agg.kind == "get_bounds" and d.allow_inf:
        df = df.where(F.abs(x) != math.inf)
    return Table(df, t.meta)


def compile_answer(agg: ir.Aggregate, scope: Scope, budget: PrivacyBudget) -> Answer:
    t = _prepared(agg, scope)
    zcdp = isinstance(budget, RhoZCDPBudget)
    if agg.kind == "get_groups":
        return _groups(agg, t, budget)
    if isinstance(agg.keys, KeySet):
        keys, named = agg.keys, list(agg.keys.columns())
    else:
        plan = agg.keys if isinstance(agg.keys, KeySetPlan) else KeySetPlan.detect(agg.keys)
        keys, named = None, plan.columns()
        t.meta.require([*named, *plan.detected])
        if not isinstance(budget, ApproxDPBudget):
            raise ValueError("finding group keys privately needs an ApproxDP budget")
        if not budget.is_infinite and not budget.amounts[1]:
            raise ValueError("finding group keys privately needs a positive delta")
    grouping = _check_keys(t.meta, keys) if keys is not None else [n for n in t.meta.columns if n in named]
    if agg.column in grouping:
        raise ValueError(f"column {agg.column!r} is a group key and can't be measured too")
    clash = [n for n in agg.names if n in grouping]
    if clash:
        raise ValueError(f"outputs {clash} have names of group keys")
    _own_group(t.meta, grouping)
    chooser = t
    if agg.kind == "count_distinct":
        t = _distinct(agg, t, grouping)
    t = bounded(t, grouping, zcdp)
    if keys is None:
        # half of epsilon and all of delta find the keys; additive noise has no use for delta
        half = ApproxDPBudget(budget.amounts[0] if budget.is_infinite else budget.amounts[0] / 2, budget.amounts[1])
        found = _groups(ir.Aggregate(agg.child, KeySet.from_dict({}), "get_groups", (), columns=plan.detected), chooser, half)
        rest = half if budget.is_infinite else ApproxDPBudget(budget.amounts[0] / 2, 0)

        def run() -> DataFrame:
            return _measure(agg, t, plan.resolve(KeySet.from_dataframe(found.run())), grouping, rest)[0]()

        return Answer(run, (*found.noises, *_measure(agg, t, KeySet.from_dict({}), grouping, rest)[1]), None)
    run, noises = _measure(agg, t, keys, grouping, budget)
    return Answer(run, noises, keys)


def _distinct(agg: ir.Aggregate, t: Table, grouping: list[str]) -> Table:
    """The rows whose count is the number of distinct ones. One that counts IDs counts each once for its group."""
    columns = list(agg.columns) if agg.columns else [n for n in t.meta.columns if n not in grouping]
    t.meta.require(columns)
    kept = [n for n in t.meta.columns if n in columns or n in grouping]
    df = t.df.select(*map(quoted, kept)).distinct()
    meta = t.meta
    if isinstance(meta.metric, Ids):
        constraints = [c for c in meta.constraints if getattr(c, "grouping_column", None) in (None, *kept)]
        if set(columns) - set(grouping) <= {meta.id_column} and meta.id_column in columns:
            if not grouping or grouping == [meta.id_column]:
                constraints = [c for c in constraints if not isinstance(c, MaxRowsPerID)] + ([MaxRowsPerID(1)] if any(isinstance(c, MaxRowsPerID) for c in constraints) or constraints else [])
            elif len(grouping) == 1:
                constraints = [c for c in constraints if not (isinstance(c, MaxRowsPerGroupPerID) and c.grouping_column == grouping[0])]
                if any(isinstance(c, MaxGroupsPerID) and c.grouping_column == grouping[0] for c in constraints):
                    constraints.append(MaxRowsPerGroupPerID(grouping[0], 1))
        meta = meta.but(constraints=tuple(constraints))
    return Table(df, meta)


def _measure(agg: ir.Aggregate, t: Table, keys: KeySet, grouping, budget):
    """(function that gives the DataFrame, noises)."""
    if agg.kind == "quantile":
        return _quantile(agg, t, keys, grouping, budget)
    if agg.kind == "get_bounds":
        return _bounds(agg, t, keys, grouping, budget)
    gaussian = _gaussian(agg.mechanism, budget)
    kind = t.meta.columns[agg.column].column_type if agg.column else None
    parts, native, plain, out = recipe(agg, kind)
    spent = additive(budget, agg.mechanism)
    noises = tuple(noise_for(p, t.meta.metric, grouping, spent, len(parts), gaussian) for p in parts)
    name, width = agg.names[0], len(grouping)

    def run() -> DataFrame:
        if budget.is_infinite:
            if native is None:
                x, _, _ = _clamped(agg, kind)
                spread = (F.stddev_samp if agg.kind == "stdev" else F.var_samp)(x.cast("double"))
                df = per_key(t.df, keys, grouping, {"__p0": spread})
                df = df.select(*map(quoted, grouping), F.coalesce("__p0", F.lit(math.nan)).alias(name))
            else:
                df = per_key(t.df, keys, grouping, {f"__p{i}": p.column for i, p in enumerate(parts)})
                df = df.select(*map(quoted, grouping), native([F.col(f"__p{i}") for i in range(len(parts))]).alias(name))
        else:
            exact = per_key(t.df, keys, grouping, {f"__p{i}": p.under(n) for i, (p, n) in enumerate(zip(parts, noises))})

            def finish(row):
                return (*row[:width], plain([n.add_steps(v or 0) for n, v in zip(noises, row[width:])]))

            df = fix(exact, keys, _schema(t.meta, grouping, {name: out}), finish)
        return df if agg.threshold is None else df.where(quoted(name) >= agg.threshold)

    return run, noises


# ---- quantiles


def _epsilon(budget: PrivacyBudget) -> float:
    """The epsilon that the exponential mechanism may use: its loss is epsilon^2 / 8 in zCDP."""
    if budget.is_infinite:
        return math.inf
    x = budget.amounts[0]
    x = root_below(8 * x) if isinstance(budget, RhoZCDPBudget) else x
    return math.nextafter(float(x), 0)


def _exact_quantile(df: DataFrame, value, q: float, keys, grouping, name: str, empty: float) -> DataFrame:
    """Per key the least value that at least the part q of its values do not pass; empty for a key without values.

    Values are counted, then ranked in blocks that follow their order, so a large group is no single task's.
    """
    counted = df.groupBy(*map(quoted, grouping), value.alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    # the leading bits of a double follow its order, among the positive ones and among the negative ones
    size = F.floor(F.log2(F.abs("__value") + 1e-300) * 16)
    counted = counted.select("*", F.when(F.col("__value") == 0, 0).otherwise(F.signum("__value") * (size + 20_000)).cast("int").alias("__block"))
    block = [*grouping, "__block"]
    group = W.partitionBy(*map(quoted, grouping))
    blocks = counted.groupBy(*map(quoted, block)).agg(F.sum("__n").alias("__sum"))
    before = F.sum("__sum").over(group.orderBy("__block").rowsBetween(W.unboundedPreceding, 0)) - F.col("__sum")
    blocks = blocks.select(*map(quoted, block), "__sum", before.alias("__before"), F.sum("__sum").over(group).alias("__total"))
    # only the block that holds the rank is ranked value by value
    held = blocks.where((F.col("__before") < F.greatest(F.col("__total") * q, F.lit(1.0))) & (F.col("__before") + F.col("__sum") >= F.greatest(F.col("__total") * q, F.lit(1.0))))
    inside = W.partitionBy(*map(quoted, block)).orderBy("__value").rowsBetween(W.unboundedPreceding, 0)
    ranked = join_keys(counted, held.drop("__sum"), block, "inner").select(*map(quoted, grouping), "__value", "__total", (F.col("__before") + F.sum("__n").over(inside)).alias("__upto"))
    found = per_key(ranked.where(F.col("__upto") >= F.col("__total") * q), keys, grouping, {"__least": F.min("__value")})
    return found.select(*map(quoted, grouping), F.coalesce("__least", F.lit(empty)).alias(name))


def _quantile(agg, t: Table, keys, grouping, budget):
    x = quoted(agg.column).cast("double")
    low, high, q = float(agg.low), float(agg.high), float(agg.quantile)
    rows, epsilon, name, width = float(_l1(t.meta.metric)), _epsilon(budget), agg.names[0], len(grouping)
    noise = Noise(NoiseMechanism.EXPONENTIAL, Fraction(0) if epsilon == math.inf else Fraction(epsilon))

    def run() -> DataFrame:
        clamped = F.least(F.greatest(x, F.lit(low)), F.lit(high))
        if epsilon == math.inf:
            kept = join_keys(t.df, _key_frame(keys), grouping, "left_semi") if grouping else t.df
            return _exact_quantile(kept, clamped, q, keys, grouping, name, (low + high) / 2)
        place = F.least(F.floor((clamped - low) / (high - low) * 2.0**PLACE).cast("long"), F.lit(2**PLACE - 1))
        kept = join_keys(t.df, _key_frame(keys), grouping, "left_semi") if grouping else t.df
        counted = kept.groupBy(*map(quoted, grouping), place.alias("__place")).agg(F.count(F.lit(1)).alias("__n"))
        # blocks follow the values' order: even ones, and within them even ones of the logarithm, so that few skewed values share one
        counted = counted.select("*", F.shiftright("__place", PLACE - BLOCK).alias("__even"), F.floor(F.log2(F.col("__place") + 1) * 64).alias("__log"))
        block = [*grouping, "__even", "__log"]
        group = W.partitionBy(*map(quoted, grouping))
        before = group.orderBy("__even", "__log")
        blocks = counted.groupBy(*map(quoted, block)).agg(F.sum("__n").alias("__sum"), F.min("__place").alias("__least"))
        blocks = blocks.select(
            *map(quoted, block),
            (F.sum("__sum").over(before.rowsBetween(W.unboundedPreceding, 0)) - F.col("__sum")).alias("__before"),
            F.lead("__least").over(before).alias("__after"),
            F.sum("__sum").over(group).alias("__total"),
            F.min("__least").over(group).alias("__first"),
        )
        inside = W.partitionBy(*map(quoted, block)).orderBy("__place")
        ranked = join_keys(counted, blocks, block, "inner").select(
            *map(quoted, grouping),
            "__place",
            "__n",
            "__total",
            "__first",
            (F.col("__before") + F.sum("__n").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__below"),
            F.coalesce(F.lead("__place").over(inside), "__after", F.lit(2**PLACE)).alias("__next"),
        )
        # the span of each value, the one up to the next, and the one before the first
        spans = """explode(array(named_struct('a', __place, 'b', __place + 1, 'under', __below + __n / 2.0D),
            named_struct('a', __place + 1, 'b', __next, 'under', cast(__below + __n as double)),
            named_struct('a', 0L, 'b', if(__place = __first, __place, 0L), 'under', 0.0D))) AS __span"""
        under, length = F.col("__span.under"), F.col("__span.b") - F.col("__span.a")
        utility = -F.abs((1 - q) * under - q * (F.col("__total") - under))
        ship(spark_session())
        found = ranked.selectExpr("*", spans).where("__span.b > __span.a").select(*map(quoted, grouping), "__span", utility.alias("__utility"), F.log(length.cast("double")).alias("__length"))
        found = found.withColumn("__draw", F.udf(gumbel, "double").asNondeterministic()())
        drawn = F.col("__length") + F.col("__draw")
        rank = drawn + F.col("__utility") * F.lit(epsilon / (2 * rows * max(q, 1 - q)))
        best = per_key(found, keys, grouping, {"__best": F.max_by("__span", rank)})

        def finish(row):
            if row[width] is None:
                return (*row[:width], min(high, low + (high - low) * uniform()))
            a, b = (row[width][k] for k in ("a", "b"))
            return (*row[:width], min(high, max(low, low + (high - low) / 2**PLACE * (a + (b - a) * uniform()))))

        return fix(best, keys, _schema(t.meta, grouping, {name: T.DoubleType()}), finish)

    return run, (noise,)


# ---- bounds


def _bounds(agg, t: Table, keys, grouping, budget):
    kind = t.meta.columns[agg.column].column_type
    exponents = EXPONENTS[kind]
    x, width = quoted(agg.column), len(grouping)
    noise = noise_for(Part(None, True, Fraction(1)), t.meta.metric, grouping, budget, 1, isinstance(budget, RhoZCDPBudget))

    def run() -> DataFrame:
        size = F.abs(x.cast("double"))
        power = F.when(size == 0, F.lit(exponents[0])).otherwise(F.greatest(F.lit(exponents[0]), F.least(F.lit(exponents[-1]), F.ceil(F.log2(size)))).cast("int"))
        kept = join_keys(t.df, _key_frame(keys), grouping, "left_semi") if grouping else t.df
        counted = kept.groupBy(*map(quoted, grouping), power.cast("int").alias("__power")).agg(F.count(F.lit(1)).alias("__n"))
        listed = per_key(counted, keys, grouping, {"__powers": F.collect_list(F.struct("__power", "__n"))})

        def finish(row):
            counts = dict(tuple(c.values()) if isinstance(c, dict) else tuple(c) for c in row[width] or [])
            noisy = [noise.add(counts.get(k, 0)) for k in exponents]
            total, so_far, chosen = sum(noisy), 0, 0
            if total > 0:
                for k, n in zip(exponents, noisy):
                    so_far += n
                    if so_far >= INSIDE * total:
                        chosen = k
                        break
            bound = min(2**chosen, 2**63 - 1) if kind is ColumnType.INTEGER else 2.0**chosen
            return (*row[:width], -bound, bound)

        return fix(listed, keys, _schema(t.meta, grouping, dict.fromkeys(agg.names, kind.spark)), finish)

    return run, (noise,)


# ---- private choice of groups


def _groups(agg, t: Table, budget: PrivacyBudget) -> Answer:
    """Groups whose noisy number of rows passes a threshold that a group of differing rows alone passes with probability delta at most."""
    if not isinstance(budget, ApproxDPBudget):
        raise ValueError("choosing groups privately needs an ApproxDP budget")
    if not budget.is_infinite and not budget.amounts[1]:
        raise ValueError("choosing groups privately needs a positive delta")
    own = t.meta.id_column
    columns = list(agg.columns) if agg.columns else [n for n in t.meta.columns if n != own]
    t.meta.require(columns)
    if own in columns:
        raise ValueError(f"the ID column {own!r} can't be grouped by")
    grouping = [n for n in t.meta.columns if n in columns]
    _own_group(t.meta, grouping)
    t = bounded(t, grouping, False)
    most = _l1(t.meta.metric)
    if budget.is_infinite:
        return Answer(lambda: t.df.select(*map(quoted, grouping)).distinct(), (Noise(NoiseMechanism.GEOMETRIC, Fraction(0)),), None)
    scale = most / budget.amounts[0]
    least = most + math.ceil(float(scale) * math.log(float(max(most, 1) / budget.amounts[1])))
    width = len(grouping)

    def finish(row):
        return row[:width] if row[width] + discrete_laplace(scale) >= least else None

    def run() -> DataFrame:
        counted = t.df.groupBy(*map(quoted, grouping)).agg(F.count(F.lit(1)).alias("__n"))
        return fix(counted, None, _schema(t.meta, grouping, {}), finish)

    return Answer(run, (Noise(NoiseMechanism.GEOMETRIC, scale),), None)

