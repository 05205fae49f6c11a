"""The registered queries of the core operators: each at an infinite budget, so that it has one exact answer."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    AddMaxRows,
    AddOneRow,
    AddRowsWithID,
    ApproxDPBudget,
    BinningSpec,
    ColumnDescriptor,
    ColumnType,
    KeySet,
    KeySetPlan,
    MaxGroupsPerID,
    MaxRowsPerGroupPerID,
    MaxRowsPerID,
    PureDPBudget,
    QueryBuilder,
    RhoZCDPBudget,
    Session,
    TruncationStrategy,
    config,
)

INF = PureDPBudget.inf()
FLAGS, STATUSES = ["A", "N", "R"], ["F", "O"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark, sf_dir, name: str, df: DataFrame | None = None, change=None, budget=INF) -> Session:
    return Session.from_dataframe(budget, name, _table(spark, sf_dir, name) if df is None else df, change or AddOneRow())


def _events(spark, sf_dir, budget=INF) -> Session:
    return _rows(spark, sf_dir, "events", change=AddRowsWithID("user_id"), budget=budget)


def _event_keys(spark, sf_dir) -> KeySet:
    return KeySet.from_dataframe(_table(spark, sf_dir, "events").select("event_type"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.round(c, 4).alias(c) if c in names else c for c in df.columns))


_FLAG_KEYS = "(VALUES ('A'), ('N'), ('R'), ('X')) AS k(l_returnflag)"


def _flags() -> KeySet:
    return KeySet.from_dict({"l_returnflag": [*FLAGS, "X"]})


# ---- counts and keys


@registered("SELECT COUNT(*) AS count FROM lineitem")
def count_total(spark, sf_dir):
    return _rows(spark, sf_dir, "lineitem").evaluate(QueryBuilder("lineitem").count(), INF)


@registered(
    f"SELECT k.l_returnflag, s.l_linestatus, COUNT(l.l_orderkey) AS count FROM {_FLAG_KEYS} CROSS JOIN (VALUES ('F'), ('O')) AS s(l_linestatus) "
    "LEFT JOIN lineitem l ON l.l_returnflag = k.l_returnflag AND l.l_linestatus = s.l_linestatus GROUP BY 1, 2"
)
def count_grouped_keyset(spark, sf_dir):
    keys = KeySet.from_dict({"l_linestatus": STATUSES, "l_returnflag": [*FLAGS, "X"]})
    return _rows(spark, sf_dir, "lineitem").evaluate(QueryBuilder("lineitem").groupby(keys).count(), INF)


@registered(f"SELECT k.l_returnflag, COUNT(l.l_orderkey) AS n FROM {_FLAG_KEYS} LEFT JOIN lineitem l USING (l_returnflag) GROUP BY 1 HAVING COUNT(l.l_orderkey) >= 1000")
def suppress_counts(spark, sf_dir):
    return _rows(spark, sf_dir, "lineitem").evaluate(QueryBuilder("lineitem").groupby(_flags()).count("n").suppress(1000), INF)


@registered("SELECT COUNT(*) AS count_distinct FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem)")
def count_distinct_rows(spark, sf_dir):
    return _rows(spark, sf_dir, "lineitem").evaluate(QueryBuilder("lineitem").select(["l_returnflag", "l_linestatus", "l_linenumber"]).count_distinct(), INF)


@registered('SELECT l_returnflag, COUNT(*) AS "count_distinct(l_suppkey, l_linenumber)" FROM (SELECT DISTINCT l_returnflag, l_suppkey, l_linenumber FROM lineitem) GROUP BY 1')
def count_distinct_columns(spark, sf_dir):
    keys = KeySet.from_dict({"l_returnflag": FLAGS})
    return _rows(spark, sf_dir, "lineitem").evaluate(QueryBuilder("lineitem").groupby(keys).count_distinct(["l_suppkey", "l_linenumber"]), INF)


def _with_nulls(spark, sf_dir) -> DataFrame:
    """events with null, NaN and infinite values, by event_id."""
    v = F.when(F.col("event_id") % 10 == 0, F.lit(None)).when(F.col("event_id") % 10 == 1, F.lit(math.nan)).when(F.col("event_id") % 10 == 2, F.lit(math.inf)).when(F.col("event_id") % 10 == 3, F.lit(-math.inf)).otherwise(F.col("value"))
    kind = F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("event_type"))
    return _table(spark, sf_dir, "events").select("event_id", "user_id", kind.alias("event_type"), v.alias("value"))


_NULLS = (
    "(SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type, CASE event_id % 10 WHEN 0 THEN NULL "
    "WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 'infinity'::DOUBLE WHEN 3 THEN '-infinity'::DOUBLE ELSE value END AS value FROM events) AS e"
)


def _special(spark, sf_dir) -> Session:
    return _rows(spark, sf_dir, "events", _with_nulls(spark, sf_dir))


@registered(f"SELECT COUNT(*) AS n FROM (SELECT DISTINCT event_type, value FROM {_NULLS})")
def count_distinct_with_nulls(spark, sf_dir):
    return _special(spark, sf_dir).evaluate(QueryBuilder("events").count_distinct(["event_type", "value"], name="n"), INF)


@registered(f"SELECT event_type, COUNT(*) AS count FROM {_NULLS} WHERE event_type IS NULL OR event_type = 'click' GROUP BY 1")
def count_null_key(spark, sf_dir):
    return _special(spark, sf_dir).evaluate(QueryBuilder("events").groupby(KeySet.from_tuples([("click",), (None,)], ["event_type"])).count(), INF)


# ---- numeric aggregations


@registered("SELECT CAST(SUM(LEAST(GREATEST(l_linenumber, 2), 5)) AS BIGINT) AS l_linenumber_sum FROM lineitem")
def sum_clamped_int(spark, sf_dir):
    return _rows(spark, sf_dir, "lineitem").evaluate(QueryBuilder("lineitem").sum("l_linenumber", 2, 5), INF)


@registered(f"SELECT k.l_returnflag, ROUND(COALESCE(SUM(CASE WHEN l_orderkey IS NOT NULL THEN LEAST(GREATEST(l_extendedprice, 1000.5), 50000) END), 0), 4) AS s FROM {_FLAG_KEYS} LEFT JOIN lineitem l USING (l_returnflag) GROUP BY 1")
def sum_clamped_float(spark, sf_dir):
    return _rounded(_rows(spark, sf_dir, "lineitem").evaluate(QueryBuilder("lineitem").groupby(_flags()).sum("l_extendedprice", 1000.5, 50000, name="s"), INF), "s")


@registered(f"SELECT k.l_returnflag, ROUND(COALESCE(AVG(CASE WHEN l_orderkey IS NOT NULL THEN LEAST(GREATEST(l_quantity, 5), 45) END), 25), 4) AS l_quantity_average FROM {_FLAG_KEYS} LEFT JOIN lineitem l USING (l_returnflag) GROUP BY 1")
def average_clamped(spark, sf_dir):
    return _rounded(_rows(spark, sf_dir, "lineitem").evaluate(QueryBuilder("lineitem").groupby(_flags()).average("l_quantity", 5, 45), INF), "l_quantity_average")


@registered("SELECT ROUND(COALESCE(AVG(LEAST(GREATEST(l_quantity, 0), 10)), 5), 4) AS a FROM lineitem WHERE l_quantity < 0")
def average_empty_group(spark, sf_dir):
    return _rounded(_rows(spark, sf_dir, "lineitem").evaluate(QueryBuilder("lineitem").filter("l_quantity < 0").average("l_quantity", 0, 10, name="a"), INF), "a")


@registered("SELECT l_returnflag, ROUND(VAR_SAMP(LEAST(GREATEST(l_discount, 0.01), 0.08)), 4) AS v FROM lineitem GROUP BY 1")
def variance_clamped(spark, sf_dir):
    query = QueryBuilder("lineitem").groupby(KeySet.from_dict({"l_returnflag": FLAGS})).variance("l_discount", 0.01, 0.08, name="v")
    return _rounded(_rows(spark, sf_dir, "lineitem").evaluate(query, INF), "v")


@registered("SELECT l_returnflag, ROUND(STDDEV_SAMP(LEAST(GREATEST(l_quantity, 5), 45)), 4) AS l_quantity_stdev FROM lineitem GROUP BY 1")
def stdev_clamped(spark, sf_dir):
    query = QueryBuilder("lineitem").groupby(KeySet.from_dict({"l_returnflag": FLAGS})).stdev("l_quantity", 5, 45)
    return _rounded(_rows(spark, sf_dir, "lineitem").evaluate(query, INF), "l_quantity_stdev")


@registered(f"SELECT k.l_returnflag, COALESCE(MIN(v) FILTER (r >= 0.25 * n), 30.0) AS \"l_quantity_quantile(0.25)\" FROM {_FLAG_KEYS} LEFT JOIN (SELECT l_returnflag, LEAST(GREATEST(l_quantity, 0), 60) AS v, ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY LEAST(GREATEST(l_quantity, 0), 60)) AS r, COUNT(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) l USING (l_returnflag) GROUP BY 1")
def quantile(spark, sf_dir):
    return _rows(spark, sf_dir, "lineitem").evaluate(QueryBuilder("lineitem").groupby(_flags()).quantile("l_quantity", 0.25, 0, 60), INF)


@registered("SELECT MIN(LEAST(GREATEST(l_quantity, 0), 60)) AS l_quantity_min FROM lineitem")
def quantile_min(spark, sf_dir):
    return _rows(spark, sf_dir, "lineitem").evaluate(QueryBuilder("lineitem").min("l_quantity", 0, 60), INF)


@registered("SELECT MAX(LEAST(GREATEST(l_quantity, 0), 60)) AS l_quantity_max FROM lineitem")
def quantile_max(spark, sf_dir):
    return _rows(spark, sf_dir, "lineitem").evaluate(QueryBuilder("lineitem").max("l_quantity", 0, 60), INF)


@registered(f"SELECT k.l_returnflag, COALESCE(MIN(v) FILTER (r >= 0.5 * n), 50000.0) AS \"l_extendedprice_median\" FROM {_FLAG_KEYS} LEFT JOIN (SELECT l_returnflag, LEAST(GREATEST(l_extendedprice, 0), 100000) AS v, ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY LEAST(GREATEST(l_extendedprice, 0), 100000)) AS r, COUNT(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) l USING (l_returnflag) GROUP BY 1")
def quantile_median(spark, sf_dir):
    return _rows(spark, sf_dir, "lineitem").evaluate(QueryBuilder("lineitem").groupby(_flags()).median("l_extendedprice", 0, 100000), INF)


@registered(
    "WITH p AS (SELECT l_returnflag, CAST(CASE WHEN l_linenumber = 0 THEN 0 ELSE CEIL(LOG2(ABS(l_linenumber))) END AS INT) AS k FROM lineitem), "
    "n AS (SELECT l_returnflag, k, COUNT(*) AS n FROM p GROUP BY 1, 2), c AS (SELECT l_returnflag, k, SUM(n) OVER (PARTITION BY l_returnflag ORDER BY k) AS c, "
    "SUM(n) OVER (PARTITION BY l_returnflag) AS t FROM n) SELECT l_returnflag, CAST(-POW(2, MIN(k)) AS BIGINT) AS low, CAST(POW(2, MIN(k)) AS BIGINT) AS high FROM c WHERE c >= 0.95 * t GROUP BY 1"
)
def get_bounds_pow2(spark, sf_dir):
    query = QueryBuilder("lineitem").groupby(KeySet.from_dict({"l_returnflag": FLAGS})).get_bounds("l_linenumber", "low", "high")
    return _rows(spark, sf_dir, "lineitem").evaluate(query, INF)


@registered("SELECT DISTINCT l_linestatus, l_returnflag FROM lineitem")
def get_groups_all(spark, sf_dir):
    everything = ApproxDPBudget.inf()
    return _rows(spark, sf_dir, "lineitem", budget=everything).evaluate(QueryBuilder("lineitem").get_groups(["l_linestatus", "l_returnflag"]), everything)


@registered("SELECT l_returnflag, COUNT(*) AS count FROM lineitem GROUP BY 1")
def count_private_keys(spark, sf_dir):
    everything = ApproxDPBudget.inf()
    with config.features.auto_partition_selection.on():
        return _rows(spark, sf_dir, "lineitem", budget=everything).evaluate(QueryBuilder("lineitem").groupby("l_returnflag").count(), everything)


# ---- projections, filters, row functions, bins


@registered("SELECT COUNT(*) AS count FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND LENGTH(l_linestatus) = 1 AND l_shipdate >= DATE '1995-01-01'")
def filter_sql(spark, sf_dir):
    condition = "l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND LENGTH(l_linestatus) = 1 AND l_shipdate >= DATE '1995-01-01'"
    return _rows(spark, sf_dir, "lineitem").evaluate(QueryBuilder("lineitem").filter(condition).count(), INF)


@registered("SELECT l_returnflag AS flag, CAST(SUM(LEAST(GREATEST(l_linenumber, 0), 9)) AS BIGINT) AS line_sum FROM lineitem GROUP BY 1")
def select_rename(spark, sf_dir):
    b = QueryBuilder("lineitem").select(["l_returnflag", "l_linenumber"]).rename({"l_returnflag": "flag", "l_linenumber": "line"})
    return _rows(spark, sf_dir, "lineitem").evaluate(b.groupby(KeySet.from_dict({"flag": FLAGS})).sum("line", 0, 9), INF)


@registered("SELECT CAST(l_linenumber % 2 AS BIGINT) AS parity, COUNT(*) AS count FROM lineitem GROUP BY 1")
def map_augment(spark, sf_dir):
    b = QueryBuilder("lineitem").select("l_linenumber").map(lambda row: {"parity": row["l_linenumber"] % 2}, {"parity": ColumnDescriptor(ColumnType.INTEGER)}, augment=True)
    return _rows(spark, sf_dir, "lineitem").evaluate(b.groupby(KeySet.from_dict({"parity": [0, 1]})).count(), INF)


@registered("SELECT CAST(SUM(LEAST(i, 3)) AS BIGINT) AS i_sum FROM (SELECT UNNEST(RANGE(LEAST(CAST(l_linenumber AS BIGINT), 4))) AS i FROM lineitem)")
def flat_map_explode(spark, sf_dir):
    b = QueryBuilder("lineitem").select("l_linenumber").flat_map(lambda row: [{"i": i} for i in range(row["l_linenumber"])], {"i": ColumnType.INTEGER}, max_rows=4)
    return _rows(spark, sf_dir, "lineitem").evaluate(b.sum("i", 0, 3), INF)


@registered("SELECT h AS half, COUNT(*) AS count FROM (SELECT UNNEST(['low', 'high']) AS h FROM lineitem) GROUP BY 1")
def flat_map_grouping(spark, sf_dir):
    b = QueryBuilder("lineitem").select("l_linenumber").flat_map(lambda row: [{"half": "low"}, {"half": "high"}], {"half": ColumnType.VARCHAR}, augment=True, grouping=True, max_rows=2)
    return _rows(spark, sf_dir, "lineitem").evaluate(b.groupby(KeySet.from_dict({"half": ["low", "high"]})).count(), INF)


@registered("SELECT CAST(SUM(LEAST(n, 100)) AS BIGINT) AS n_sum FROM (SELECT user_id, COUNT(*) AS n FROM events GROUP BY 1)")
def flat_map_by_id(spark, sf_dir):
    b = QueryBuilder("events").select(["user_id", "event_id"]).flat_map_by_id(lambda rows: [{"n": len(rows)}], {"n": ColumnType.INTEGER}).enforce(MaxRowsPerID(1))
    return _events(spark, sf_dir).evaluate(b.sum("n", 0, 100), INF)


_BINS = "CASE WHEN l_quantity >= 0 AND l_quantity <= 10 THEN '[0, 10]' WHEN l_quantity > 10 AND l_quantity <= 25 THEN '(10, 25]' WHEN l_quantity > 25 AND l_quantity <= 40 THEN '(25, 40]' END"


@registered(f"SELECT {_BINS} AS l_quantity_binned, CAST(SUM(LEAST(l_linenumber, 9)) AS BIGINT) AS s FROM lineitem WHERE l_quantity <= 40 GROUP BY 1")
def bin_column_sum(spark, sf_dir):
    spec = BinningSpec([0, 10, 25, 40])
    b = QueryBuilder("lineitem").bin_column("l_quantity", spec)
    return _rows(spark, sf_dir, "lineitem").evaluate(b.groupby(KeySet.from_dict({"l_quantity_binned": spec.bins()})).sum("l_linenumber", 0, 9, name="s"), INF)


@registered(f"SELECT {_BINS} AS l_quantity_binned, COUNT(*) AS count FROM lineitem WHERE l_quantity <= 40 GROUP BY 1")
def histogram(spark, sf_dir):
    return _rows(spark, sf_dir, "lineitem").evaluate(QueryBuilder("lineitem").histogram("l_quantity", [0, 10, 25, 40]), INF)


@registered("SELECT CASE WHEN l_linenumber >= 1 AND l_linenumber < 3 THEN '[1, 3)' ELSE '[3, 6)' END AS bin, COUNT(*) AS count FROM lineitem WHERE l_linenumber >= 1 AND l_linenumber < 6 GROUP BY 1")
def histogram_left_closed(spark, sf_dir):
    spec = BinningSpec([1, 3, 6], right=False, include_both_endpoints=False)
    return _rows(spark, sf_dir, "lineitem").evaluate(QueryBuilder("lineitem").histogram("l_linenumber", spec, name="bin"), INF)


_DAYS = "(VALUES ('early'), ('middle'), ('late')) AS k(era)"


@registered(
    f"SELECT era, COUNT(l_orderkey) AS count FROM {_DAYS} LEFT JOIN (SELECT l_orderkey, CASE WHEN l_shipdate >= TIMESTAMP '1992-01-01' AND l_shipdate < TIMESTAMP '1994-06-01' THEN 'early' "
    "WHEN l_shipdate >= TIMESTAMP '1994-06-01' AND l_shipdate < TIMESTAMP '1997-01-01 12:30:00' THEN 'middle' "
    "WHEN l_shipdate >= TIMESTAMP '1997-01-01 12:30:00' AND l_shipdate <= TIMESTAMP '1999-01-01' THEN 'late' END AS era FROM lineitem) USING (era) GROUP BY 1"
)
def histogram_timestamps(spark, sf_dir):
    at = datetime.datetime
    spec = BinningSpec([at(1992, 1, 1), at(1994, 6, 1), at(1997, 1, 1, 12, 30), at(1999, 1, 1)], names=["early", "middle", "late"], right=False)
    return _rows(spark, sf_dir, "lineitem").evaluate(QueryBuilder("lineitem").histogram("l_shipdate", spec, name="era"), INF)


@registered(
    "SELECT year, COUNT(day) AS count FROM (VALUES ('1993'), ('1994'), ('1995')) AS k(year) LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS day FROM orders) "
    "ON CAST(EXTRACT(year FROM day) AS VARCHAR) = year GROUP BY 1"
)
def histogram_dates(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    spec = BinningSpec([datetime.date(y, 1, 1) for y in range(1993, 1997)], names=["1993", "1994", "1995"], right=False, include_both_endpoints=False)
    return _rows(spark, sf_dir, "orders", orders).evaluate(QueryBuilder("orders").histogram("day", spec, name="year"), INF)


@registered(
    f"SELECT b AS bin, COUNT(*) AS count FROM (SELECT CASE WHEN isnan(value) THEN 'not a number' WHEN value >= 0 AND value <= 50 THEN 'low' WHEN value > 50 AND value <= 1000 THEN 'high' END AS b FROM {_NULLS}) WHERE b IS NOT NULL GROUP BY 1"
)
def histogram_nan_bin(spark, sf_dir):
    spec = BinningSpec([0.0, 50.0, 1000.0], names=["low", "high"], nan_bin="not a number")
    return _special(spark, sf_dir).evaluate(QueryBuilder("events").histogram("value", spec, name="bin"), INF)


@registered("SELECT CAST(CEIL(l_extendedprice / 50) AS BIGINT) AS bin, COUNT(*) AS count FROM lineitem WHERE l_extendedprice > 0 AND l_extendedprice <= 100000 GROUP BY 1")
def histogram_many_bins(spark, sf_dir):
    spec = BinningSpec([50.0 * k for k in range(2001)], names=list(range(1, 2001)), include_both_endpoints=False)
    return _rows(spark, sf_dir, "lineitem").evaluate(QueryBuilder("lineitem").histogram("l_extendedprice", spec, name="bin").suppress(1), INF)


# ---- special values


@registered(f"SELECT COALESCE(event_type, 'none') AS event_type, COUNT(*) AS count FROM {_NULLS} WHERE COALESCE(event_type, 'none') IN ('none', 'click') GROUP BY 1")
def replace_null_string(spark, sf_dir):
    b = QueryBuilder("events").replace_null_and_nan({"event_type": "none"})
    return _special(spark, sf_dir).evaluate(b.groupby(KeySet.from_dict({"event_type": ["none", "click"]})).count(), INF)


@registered(f"SELECT ROUND(SUM(LEAST(GREATEST(CASE WHEN value IS NULL OR isnan(value) THEN 7.0 ELSE value END, 0), 50)), 4) AS s FROM {_NULLS}")
def replace_null_nan(spark, sf_dir):
    return _rounded(_special(spark, sf_dir).evaluate(QueryBuilder("events").replace_null_and_nan({"value": 7.0}).sum("value", 0, 50, name="s"), INF), "s")


@registered(f"SELECT ROUND(SUM(LEAST(GREATEST(CASE WHEN value = 'infinity'::DOUBLE THEN 3 WHEN value = '-infinity'::DOUBLE THEN 2 ELSE value END, 0), 50)), 4) AS s FROM {_NULLS} WHERE value IS NOT NULL AND NOT isnan(value)")
def replace_infinity(spark, sf_dir):
    return _rounded(_special(spark, sf_dir).evaluate(QueryBuilder("events").replace_infinity({"value": (2.0, 3.0)}).sum("value", 0, 50, name="s"), INF), "s")


@registered(f"SELECT COUNT(*) AS count FROM {_NULLS} WHERE event_type IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
def drop_null_nan(spark, sf_dir):
    return _special(spark, sf_dir).evaluate(QueryBuilder("events").drop_null_and_nan(["event_type", "value"]).count(), INF)


@registered(f"SELECT COUNT(*) AS count FROM {_NULLS} WHERE value IS NULL OR isnan(value) OR NOT isinf(value)")
def drop_infinity(spark, sf_dir):
    return _special(spark, sf_dir).evaluate(QueryBuilder("events").drop_infinity("value").count(), INF)


@registered(f"SELECT ROUND(AVG(LEAST(GREATEST(value, 10), 90)), 4) AS a FROM {_NULLS} WHERE value IS NOT NULL AND NOT isnan(value)")
def implicit_special_values(spark, sf_dir):
    return _rounded(_special(spark, sf_dir).evaluate(QueryBuilder("events").average("value", 10, 90, name="a"), INF), "a")


# ---- joins


@registered("SELECT n_name, COUNT(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_public_inner(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    b = QueryBuilder("customer").join_public(nation)
    return _rows(spark, sf_dir, "customer").evaluate(b.groupby(KeySet.from_dataframe(nation.select("n_name"))).count(), INF)


@registered("SELECT label, COUNT(*) AS count FROM (SELECT CASE WHEN c_nationkey < 10 THEN 'small' END AS label FROM customer) GROUP BY 1")
def join_public_left(spark, sf_dir):
    some = _table(spark, sf_dir, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("c_nationkey"), F.lit("small").alias("label"))
    b = QueryBuilder("customer").join_public(some, how="left")
    return _rows(spark, sf_dir, "customer").evaluate(b.groupby(KeySet.from_tuples([("small",), (None,)], ["label"])).count(), INF)


@registered("SELECT CAST(a.c_mktsegment AS VARCHAR) AS c_mktsegment_left, b.c_mktsegment AS c_mktsegment_right, COUNT(*) AS count FROM customer a JOIN (VALUES (1, 'x'), (1, 'y'), (2, 'x')) AS b(c_nationkey, c_mktsegment) USING (c_nationkey) GROUP BY 1, 2")
def join_public_suffix(spark, sf_dir):
    public = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "c_nationkey long, c_mktsegment string")
    b = QueryBuilder("customer").join_public(public, join_columns=["c_nationkey"])
    customer = _table(spark, sf_dir, "customer")
    keys = KeySet.from_dataframe(customer.where("c_nationkey in (1, 2)").select(F.col("c_mktsegment").alias("c_mktsegment_left"))) * KeySet.from_dict({"c_mktsegment_right": ["x", "y"]})
    return _rows(spark, sf_dir, "customer").evaluate(b.groupby(keys).count().suppress(1), INF)


@registered(f"SELECT n AS note, COUNT(*) AS count FROM {_NULLS} JOIN (VALUES ('click', 'c'), (NULL, 'none')) AS p(event_type, n) ON e.event_type IS NOT DISTINCT FROM p.event_type GROUP BY 1")
def join_public_nullsafe(spark, sf_dir):
    public = spark.createDataFrame([("click", "c"), (None, "none")], "event_type string, note string")
    b = QueryBuilder("events").join_public(public)
    return _special(spark, sf_dir).evaluate(b.groupby(KeySet.from_dict({"note": ["c", "none"]})).count(), INF)


def _orders_and_customers(spark, sf_dir) -> Session:
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_totalprice")
    builder = Session.Builder().with_privacy_budget(INF).with_private_dataframe("orders", orders, AddMaxRows(2))
    return builder.with_private_dataframe("customer", _table(spark, sf_dir, "customer"), AddOneRow()).build()


@registered("SELECT CAST(SUM(LEAST(n, 3)) AS BIGINT) AS count FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey")
def join_private_drop_excess(spark, sf_dir):
    b = QueryBuilder("orders").join_private("customer", TruncationStrategy.DropExcess(3), TruncationStrategy.DropExcess(1))
    return _orders_and_customers(spark, sf_dir).evaluate(b.count(), INF)


@registered("SELECT COUNT(*) AS count FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING COUNT(*) = 1) JOIN customer ON o_custkey = c_custkey")
def join_private_drop_non_unique(spark, sf_dir):
    b = QueryBuilder("orders").join_private(QueryBuilder("customer"), TruncationStrategy.DropNonUnique(), TruncationStrategy.DropNonUnique())
    return _orders_and_customers(spark, sf_dir).evaluate(b.count(), INF)


@registered(
    "SELECT COUNT(*) AS count FROM (SELECT user_id, LEAST(COUNT(*), 5) AS a FROM events WHERE event_type = 'click' GROUP BY 1) x "
    "JOIN (SELECT user_id, COUNT(*) AS b FROM events WHERE event_type = 'purchase' GROUP BY 1) y USING (user_id), UNNEST(RANGE(CAST(LEAST(a, 5) * LEAST(b, 2) AS BIGINT))) AS u(i)"
)
def join_private_ids(spark, sf_dir):
    clicks = QueryBuilder("events").filter("event_type = 'click'").select(["user_id", "event_id"]).enforce(MaxRowsPerID(5))
    bought = QueryBuilder("events").filter("event_type = 'purchase'").select(["user_id", "value"]).enforce(MaxRowsPerID(2))
    return _events(spark, sf_dir).evaluate(clicks.join_private(bought, join_columns=["user_id"]).count(), INF)


def _customers_with_nation(spark, sf_dir) -> Session:
    builder = Session.Builder().with_privacy_budget(INF).with_private_dataframe("customer", _table(spark, sf_dir, "customer"), AddOneRow())
    return builder.with_public_dataframe("nation", _table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")).build()


@registered("SELECT n_regionkey, COUNT(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_public_by_name(spark, sf_dir):
    session = _customers_with_nation(spark, sf_dir)
    return session.evaluate(QueryBuilder("customer").join_public("nation").groupby(KeySet.from_dict({"n_regionkey": list(range(5))})).count(), INF)


@registered("SELECT CAST(SUM(LEAST(n, 2) * LEAST(n, 3)) AS BIGINT) AS count FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1)")
def join_private_self(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    b = QueryBuilder("orders").join_private("orders", TruncationStrategy.DropExcess(2), TruncationStrategy.DropExcess(3), join_columns=["o_custkey"])
    return _rows(spark, sf_dir, "orders", orders).evaluate(b.count(), INF)


@registered(
    "SELECT * FROM (VALUES ('c_name', false, false, false), ('c_nationkey', false, false, false), ('n_name', true, false, false), ('ratio', false, false, true), ('ratio2', true, true, true)) AS t(name, may_be_null, may_be_nan, may_be_inf)"
)
def column_flags(spark, sf_dir):
    """What may be special in the columns after a left join, a row function, and replaced values."""
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    customer = _table(spark, sf_dir, "customer").select(F.coalesce("c_name", F.lit("")).alias("c_name"), F.coalesce("c_nationkey", F.lit(0)).alias("c_nationkey"))
    session = _rows(spark, sf_dir, "customer", customer)
    ratio = ColumnDescriptor(ColumnType.DECIMAL, allow_null=True, allow_nan=True, allow_inf=True)
    b = QueryBuilder("customer").map(lambda row: {"ratio": None, "ratio2": math.nan}, {"ratio": ratio, "ratio2": ratio}, augment=True)
    session.create_view(b.replace_null_and_nan({"ratio": 0.0}).join_public(nation, how="left"), "v", cache=False)
    flags = {n: (d.allow_null, d.allow_nan, d.allow_inf) for n, d in session.get_schema("v").items()}
    return spark.createDataFrame([(n, *f) for n, f in sorted(flags.items())], "name string, may_be_null boolean, may_be_nan boolean, may_be_inf boolean")


# ---- bounds on contributions


@registered("SELECT CAST(SUM(LEAST(n, 20)) AS BIGINT) AS count FROM (SELECT user_id, COUNT(*) AS n FROM events GROUP BY 1)")
def enforce_max_rows(spark, sf_dir):
    return _events(spark, sf_dir).evaluate(QueryBuilder("events").enforce(MaxRowsPerID(20)).count(), INF)


@registered("SELECT CAST(SUM(LEAST(n, 2)) AS BIGINT) AS n FROM (SELECT user_id, COUNT(DISTINCT event_type) AS n FROM events GROUP BY 1)")
def enforce_max_groups(spark, sf_dir):
    b = QueryBuilder("events").enforce(MaxGroupsPerID("event_type", 2)).enforce(MaxRowsPerGroupPerID("event_type", 100))
    return _events(spark, sf_dir).evaluate(b.count_distinct(["user_id", "event_type"], name="n"), INF)


@registered("SELECT event_type, CAST(SUM(LEAST(n, 3)) AS BIGINT) AS count FROM (SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def enforce_max_rows_per_group(spark, sf_dir):
    b = QueryBuilder("events").enforce(MaxRowsPerGroupPerID("event_type", 3)).enforce(MaxGroupsPerID("event_type", 10))
    return _events(spark, sf_dir).evaluate(b.groupby(_event_keys(spark, sf_dir)).count(), INF)


@registered("SELECT CAST(SUM(LEAST(n, 2) * 4) AS BIGINT) AS count FROM (SELECT user_id, COUNT(DISTINCT event_type) AS n FROM (SELECT user_id, event_type FROM events GROUP BY 1, 2 HAVING COUNT(*) >= 4) GROUP BY 1)")
def enforce_l0_linf(spark, sf_dir):
    busy = _table(spark, sf_dir, "events").groupBy("user_id", "event_type").count().where("count >= 4").drop("count")
    b = QueryBuilder("events").join_public(busy).enforce(MaxGroupsPerID("event_type", 2)).enforce(MaxRowsPerGroupPerID("event_type", 4))
    return _events(spark, sf_dir).evaluate(b.count(), INF)


@registered("SELECT COUNT(DISTINCT user_id) AS n FROM events")
def count_distinct_id_optimized(spark, sf_dir):
    return _events(spark, sf_dir).evaluate(QueryBuilder("events").enforce(MaxRowsPerID(3)).count_distinct(["user_id"], name="n"), INF)


# ---- key sets


@registered("SELECT DISTINCT c_nationkey FROM customer")
def keyset_project(spark, sf_dir):
    keys = KeySet.from_dataframe(_table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")) * KeySet.from_dict({"x": [1, 2]})
    return keys["c_nationkey"].dataframe()


@registered("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_nationkey > 20 AND c_mktsegment <> 'BUILDING'")
def keyset_filter(spark, sf_dir):
    return KeySet.from_dataframe(_table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")).filter("c_nationkey > 20").filter(F.col("c_mktsegment") != "BUILDING").dataframe()


@registered("SELECT DISTINCT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def keyset_union(spark, sf_dir):
    a = KeySet.from_dataframe(_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")))
    return a.union(KeySet.from_dataframe(_table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))).dataframe()


@registered("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_nationkey NOT IN (1, 2, 3)")
def keyset_subtract(spark, sf_dir):
    return (KeySet.from_dataframe(_table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")) - KeySet.from_dict({"c_nationkey": [1, 2, 3]})).dataframe()


@registered("SELECT DISTINCT n_regionkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def keyset_join(spark, sf_dir):
    nation = KeySet.from_dataframe(_table(spark, sf_dir, "nation").select("n_regionkey", "n_name"))
    region = KeySet.from_dataframe(_table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"))
    return nation.join(region).dataframe()


@registered("SELECT n_name, CAST(i AS BIGINT) AS i, s FROM (SELECT DISTINCT n_name FROM nation) CROSS JOIN RANGE(300) AS r(i) CROSS JOIN (VALUES ('a'), ('b'), (NULL)) AS v(s)")
def keyset_cross(spark, sf_dir):
    return (KeySet.from_dataframe(_table(spark, sf_dir, "nation").select("n_name")) * KeySet.from_dict({"i": list(range(300))}) * KeySet.from_tuples([("a",), ("b",), (None,)], ["s"])).dataframe()


@registered("SELECT c_nationkey AS k, c_mktsegment AS s FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)")
def keyset_from_pandas(spark, sf_dir):
    made = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("s")).distinct().toPandas()
    return KeySet.from_pandas(made).dataframe()


@registered(
    "SELECT 'product' AS name, (SELECT COUNT(DISTINCT c_nationkey) FROM customer) * 3 AS n, true AS same UNION ALL SELECT 'subtracted', (SELECT COUNT(DISTINCT c_nationkey) FROM customer WHERE c_nationkey > 1) * 3, false "
    "UNION ALL SELECT 'projected', 3, false"
)
def keyset_sizes(spark, sf_dir):
    """Sizes of key sets, and whether each is the product, told by comparison."""
    nations = KeySet.from_dataframe(_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")))
    product = nations * KeySet.from_dict({"x": [1, 2, 3]})
    sets = {"product": (KeySet.from_dict({"x": [3, 1, 2, 1]}) * nations)[["k", "x"]], "subtracted": product - KeySet.from_dict({"k": [0, 1]}), "projected": product["x"]}
    return spark.createDataFrame([(n, k.size(), k == product) for n, k in sets.items()], "name string, n long, same boolean")


@registered(
    "SELECT f.l_returnflag, CAST(x AS BIGINT) AS l_linenumber, COUNT(l_orderkey) AS count FROM (SELECT DISTINCT l_returnflag FROM lineitem WHERE l_returnflag <> 'A' UNION ALL SELECT 'Z') f "
    "CROSS JOIN (VALUES (1), (2), (99)) AS v(x) LEFT JOIN lineitem l ON l.l_returnflag = f.l_returnflag AND l.l_linenumber = x GROUP BY 1, 2"
)
def keyset_plan(spark, sf_dir):
    """Detected flags, less one, times line numbers, and one more flag."""
    everything = ApproxDPBudget.inf()
    plan = (KeySetPlan.detect("l_returnflag").filter("l_returnflag <> 'A'").union(KeySet.from_dict({"l_returnflag": ["Z"]}))) * KeySet.from_dict({"l_linenumber": [1, 2, 99]})
    with config.features.auto_partition_selection.on():
        return _rows(spark, sf_dir, "lineitem", budget=everything).evaluate(QueryBuilder("lineitem").groupby(plan).count(), everything)


# ---- sessions


@registered("SELECT l_returnflag AS part, COUNT(*) AS count FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def partition_split_counts(spark, sf_dir):
    parts = _rows(spark, sf_dir, "lineitem").partition_and_create("lineitem", INF, "l_returnflag", {"a": "A", "r": "R"})
    found = [s.evaluate(QueryBuilder(n).count(), INF).select(F.lit(n.upper()).alias("part"), "count") for n, s in parts.items()]
    return found[0].union(found[1])


@registered("SELECT l_linestatus, COUNT(*) AS count FROM lineitem WHERE l_quantity > 25 GROUP BY 1")
def view_then_count(spark, sf_dir):
    session = _rows(spark, sf_dir, "lineitem")
    session.create_view(QueryBuilder("lineitem").filter("l_quantity > 25").select(["l_linestatus", "l_quantity"]), "large", cache=False)
    return session.evaluate(QueryBuilder("large").groupby(KeySet.from_dict({"l_linestatus": STATUSES})).count(), INF)


@registered("SELECT l_linestatus, COUNT(*) AS count FROM lineitem WHERE l_quantity > 25 GROUP BY 1")
def view_cached(spark, sf_dir):
    """A cached view under a name that a deleted one had."""
    session = _rows(spark, sf_dir, "lineitem")
    session.create_view(QueryBuilder("lineitem").filter("l_quantity > 40"), "large", cache=True)
    session.delete_view("large")
    session.create_view(QueryBuilder("lineitem").filter("l_quantity > 25").select(["l_linestatus", "l_quantity"]), "large", cache=True)
    return session.evaluate(QueryBuilder("large").groupby(KeySet.from_dict({"l_linestatus": STATUSES})).count(), INF)


@registered("SELECT event_type AS part, CAST(SUM(LEAST(n, 10)) AS BIGINT) AS count FROM (SELECT event_type, user_id, COUNT(*) AS n FROM events GROUP BY 1, 2) WHERE event_type IN ('click', 'purchase') GROUP BY 1")
def partition_ids(spark, sf_dir):
    """Parts of an ID table, which go on hiding whole IDs."""
    session = _events(spark, sf_dir)
    session.create_view(QueryBuilder("events").enforce(MaxGroupsPerID("event_type", 50)).enforce(MaxRowsPerGroupPerID("event_type", 10)), "bounded", cache=False)
    parts = session.partition_and_create("bounded", INF, "event_type", {"click": "click", "purchase": "purchase"})
    found = [s.evaluate(QueryBuilder(n).count(), INF).select(F.lit(n).alias("part"), "count") for n, s in parts.items()]
    return found[0].union(found[1])


@registered(
    "SELECT name, mechanism, CAST(parameter AS DOUBLE) AS parameter FROM (VALUES ('average', 'LAPLACE', 100.0), ('average', 'GEOMETRIC', 10.0), ('bounded groups', 'DISCRETE_GAUSSIAN', 9.0), ('count', 'GEOMETRIC', 2.0), ('distinct ids', 'GEOMETRIC', 1.0), "
    "('join', 'GEOMETRIC', 12.0), ('sum', 'GAUSSIAN', 12.5)) AS t(name, mechanism, parameter)"
)
def noise_parameters(spark, sf_dir):
    """Mechanism and parameter of the noise that queries would get for a budget of one."""
    pure, zcdp = PureDPBudget(1), RhoZCDPBudget(1)
    b = QueryBuilder("events")
    in_groups = b.enforce(MaxGroupsPerID("event_type", 2)).enforce(MaxRowsPerGroupPerID("event_type", 3)).groupby(KeySet.from_dict({"event_type": ["click"]}))
    public = spark.createDataFrame([("click", 1), ("click", 2), ("view", 1)], "event_type string, k long")
    asked = [
        ("count", b.enforce(MaxRowsPerID(2)).count(), pure),
        ("average", b.enforce(MaxRowsPerID(5)).average("value", 0, 20), pure),
        ("sum", b.enforce(MaxRowsPerID(5)).sum("value", 0, 1), zcdp),
        ("bounded groups", in_groups.count(), zcdp),
        ("distinct ids", b.enforce(MaxRowsPerID(9)).count_distinct(["user_id"]), pure),
        ("join", b.enforce(MaxRowsPerID(6)).join_public(public).count(), pure),
    ]
    rows = [(n, i["noise_mechanism"].name, float(i["noise_parameter"])) for n, query, budget in asked for i in _events(spark, sf_dir, budget)._noise_info(query, budget)]
    return spark.createDataFrame(rows, "name string, mechanism string, parameter double")


@registered("SELECT name, CAST(epsilon AS DOUBLE) AS epsilon FROM (VALUES ('after a count', 1.5), ('after one too dear', 1.5), ('after a part', 1.0)) AS t(name, epsilon)")
def budget_spent(spark, sf_dir):
    """What is left of an epsilon of two: a query spends its share, one that asks for too much nothing, and parts their budget once."""
    session = _rows(spark, sf_dir, "lineitem", budget=PureDPBudget(2))
    left = lambda name: (name, float(session.remaining_privacy_budget.epsilon))
    session._evaluate_with_noise_info(QueryBuilder("lineitem").count(), PureDPBudget(0.5))
    rows = [left("after a count")]
    try:
        session.evaluate(QueryBuilder("lineitem").count(), PureDPBudget(1.75))
    except RuntimeError:
        rows.append(left("after one too dear"))
    parts = session.partition_and_create("lineitem", PureDPBudget(0.5), "l_returnflag", {"a": "A", "r": "R"})
    for part in parts.values():
        part.stop()
    rows.append(left("after a part"))
    return spark.createDataFrame(rows, "name string, epsilon double")
