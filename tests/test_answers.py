"""Exact answers at infinite budgets, under pure DP and zCDP, on small tables."""

import math

import pytest

from veilspark import (
    AddMaxRows,
    AddMaxRowsInMaxGroups,
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

INFINITE = [PureDPBudget.inf(), RhoZCDPBudget.inf(), ApproxDPBudget.inf()]
ROWS = [("0", 0, 0), ("0", 0, 1), ("0", 1, 2), ("1", 0, 3)]
A3 = KeySet.from_dict({"A": ["0", "1", "2"]})


@pytest.fixture(params=INFINITE, ids=["pure", "zcdp", "approx"])
def budget(request):
    return request.param


@pytest.fixture
def session(spark, budget):
    builder = Session.Builder().with_privacy_budget(budget).with_private_dataframe("rows", spark.createDataFrame(ROWS, "A string, B long, X long"), AddOneRow())
    return builder.with_public_dataframe("public", spark.createDataFrame([("0", 0), ("0", 1), ("1", 1), ("1", 2)], "A string, `A+B` long")).build()


def answer(session, query):
    return sorted(map(tuple, session.evaluate(query, session.remaining_privacy_budget).collect()), key=str)


CASES = {
    "total": (lambda q: q.count(), [(4,)]),
    "by key": (lambda q: q.groupby(A3).count(), [("0", 3), ("1", 1), ("2", 0)]),
    "two columns": (lambda q: q.groupby(KeySet.from_dict({"B": [0, 1], "A": ["0", "1"]})).count(), [("0", 0, 2), ("0", 1, 1), ("1", 0, 1), ("1", 1, 0)]),
    "empty key set": (lambda q: q.groupby(KeySet.from_dict({})).count(), [(4,)]),
    "suppressed": (lambda q: q.groupby(KeySet.from_dict({"A": ["0", "1"], "B": [0, 1]})).count().suppress(1), [("0", 0, 2), ("0", 1, 1), ("1", 0, 1)]),
    "sum": (lambda q: q.groupby(KeySet.from_dict({"A": ["0", "1"]})).sum("X", 0, 1), [("0", 2), ("1", 1)]),
    "average of none": (lambda q: q.groupby(A3).average("X", 0, 10), [("0", 1.0), ("1", 3.0), ("2", 5.0)]),
    "distinct": (lambda q: q.select(["A"]).count_distinct(), [(2,)]),
    "left-closed bins": (lambda q: q.histogram("X", BinningSpec([0, 2, 4], right=False)), [("[0, 2)", 2), ("[2, 4]", 2)]),
    "flat map": (lambda q: q.flat_map(lambda r: [{"Y": r["X"]}] * 2, {"Y": ColumnType.INTEGER}, max_rows=2).sum("Y", 0, 3), [(12,)]),
    "flat map of nothing": (lambda q: q.flat_map(lambda r: [{"Y": 1}] * 2, {"Y": ColumnType.INTEGER}, max_rows=0).count(), [(0,)]),
    "map": (lambda q: q.map(lambda r: {"C": r["A"] + "!"}, {"C": "VARCHAR"}).groupby(KeySet.from_dict({"C": ["0!", "1!"]})).count(), [("0!", 3), ("1!", 1)]),
    "public join": (lambda q: q.join_public("public").groupby(KeySet.from_dict({"A+B": [0, 1, 2]})).count(), [(0, 3), (1, 4), (2, 1)]),
    "suffixes": (lambda q: q.join_public("public", ["A"]).join_public("public", ["A"]).join_public("public", ["A"]).count(), None),
    "filter": (lambda q: q.filter("A = '0' AND X BETWEEN 1 AND 2").count(), [(2,)]),
    "a filter that divides by zero": (lambda q: q.filter("1 / X > 0.4").count(), [(2,)]),
    "rename": (lambda q: q.rename({"A": "Z"}).groupby(KeySet.from_dict({"Z": ["1"]})).count(), [("1", 1)]),
    "deviation": (lambda q: q.groupby(KeySet.from_dict({"A": ["0"]})).stdev("X", 0, 9), [("0", 1.0)]),
    "variance": (lambda q: q.groupby(KeySet.from_dict({"A": ["0"]})).variance("X", 0, 9), [("0", 1.0)]),
    "bounds": (lambda q: q.get_bounds("X"), [(-4, 4)]),
}


@pytest.mark.parametrize("name", [n for n in CASES if n != "suffixes"])
def test_exact(session, name):
    make, want = CASES[name]
    assert answer(session, make(QueryBuilder("rows"))) == want


def test_join_suffixes(session):
    b = QueryBuilder("rows").join_public("public", ["A"]).rename({"A+B": "B2"}).join_public("public", ["A"])
    assert answer(session, b.count()) == [(16,)]
    other = session.public_source_dataframes["public"].withColumnRenamed("A+B", "B")
    got = session._describe(QueryBuilder("rows").join_public(other, ["A"]))
    assert "B_left" in got and "B_right" in got


def test_variance_of_few_is_nan(session):
    got = answer(session, QueryBuilder("rows").groupby(A3).variance("X", 0, 9))
    assert math.isnan(got[1][1]) and math.isnan(got[2][1])


def test_quantiles(session):
    b = QueryBuilder("rows")
    for query, low, high in ((b.min("X", 0, 3), 0, 0.1), (b.max("X", 0, 3), 2.9, 3), (b.median("X", 0, 3), 0.9, 2.1), (b.quantile("X", 0.25, 0, 3), 0, 1.1)):
        ((value,),) = answer(session, query)
        assert low <= value <= high


def test_columns_follow_the_table(session):
    df = session.evaluate(QueryBuilder("rows").groupby(KeySet.from_dict({"B": [0], "A": ["0"]})).count("n"), session.remaining_privacy_budget)
    assert df.columns == ["A", "B", "n"]


IDS = [(1, "A", "X", 4), (1, "A", "Y", 5), (1, "A", "X", 6), (2, "A", "Y", 7), (3, "A", "X", 8), (3, "B", "Y", 9)]


@pytest.fixture
def ids(spark, budget):
    df = spark.createDataFrame(IDS, "id long, g string, g2 string, n long")
    builder = Session.Builder().with_privacy_budget(budget).with_id_space("a").with_private_dataframe("ids", df, AddRowsWithID("id", "a"))
    return builder.with_private_dataframe("more", spark.createDataFrame([(1, 10), (1, 20), (3, 30), (None, 5)], "id long, m long"), AddRowsWithID("id", "a")).build()


G = KeySet.from_dict({"g": ["A", "B", "C"]})
ID_CASES = {
    "rows": (lambda q: q.enforce(MaxRowsPerID(2)).count(), [(5,)]),
    "one row": (lambda q: q.enforce(MaxRowsPerID(1)).count(), [(3,)]),
    "rows in groups": (lambda q: q.enforce(MaxGroupsPerID("g", 2)).enforce(MaxRowsPerGroupPerID("g", 1)).groupby(G).count(), [("A", 3), ("B", 1), ("C", 0)]),
    "one group": (lambda q: q.enforce(MaxGroupsPerID("g", 1)).enforce(MaxRowsPerGroupPerID("g", 9)).select(["id", "g"]).count_distinct(["id", "g"]), [(3,)]),
    "ids": (lambda q: q.enforce(MaxRowsPerID(5)).count_distinct(["id"]), [(3,)]),
    "by id": (lambda q: q.flat_map_by_id(lambda rows: [{"k": len(rows)}], {"k": ColumnType.INTEGER}).enforce(MaxRowsPerID(1)).sum("k", 0, 9), [(6,)]),
    "joined": (lambda q: q.enforce(MaxRowsPerID(3)).join_private(QueryBuilder("more").enforce(MaxRowsPerID(2))).count(), [(8,)]),
    "flat map": (lambda q: q.flat_map(lambda r: [{"k": 1}] * r["n"], {"k": ColumnType.INTEGER}, augment=True).enforce(MaxRowsPerID(100)).count(), [(39,)]),
}


@pytest.mark.parametrize("name", ID_CASES)
def test_ids(ids, name):
    make, want = ID_CASES[name]
    assert answer(ids, make(QueryBuilder("ids"))) == want


def test_null_is_an_id(ids):
    assert answer(ids, QueryBuilder("more").enforce(MaxRowsPerID(1)).count()) == [(3,)]
    assert ids.get_schema("ids")["id"].allow_null


def test_unbounded_ids_are_refused(ids):
    with pytest.raises(RuntimeError, match="MaxRowsPerID"):
        ids.evaluate(QueryBuilder("ids").count(), ids.remaining_privacy_budget)
    with pytest.raises(RuntimeError):
        ids.evaluate(QueryBuilder("ids").enforce(MaxRowsPerID(2)).flat_map_by_id(lambda r: [], {"k": "INTEGER"}).count(), ids.remaining_privacy_budget)


SPECIAL = [("a", 1, 1.0), (None, 2, math.nan), ("b", None, math.inf), ("b", 4, -math.inf), ("c", 5, None)]


@pytest.fixture
def special(spark, budget):
    return Session.from_dataframe(budget, "t", spark.createDataFrame(SPECIAL, "s string, i long, f double"), AddOneRow())


SPECIAL_CASES = {
    "implicit drop and clamp": (lambda q: q.sum("f", -2, 7), [(6.0,)]),
    "drop": (lambda q: q.drop_null_and_nan().count(), [(2,)]),
    "drop one": (lambda q: q.drop_null_and_nan("s").count(), [(4,)]),
    "drop infinity": (lambda q: q.drop_infinity().count(), [(3,)]),
    "replace": (lambda q: q.replace_null_and_nan().sum("i", 0, 9), [(12,)]),
    "replace with": (lambda q: q.replace_null_and_nan({"f": 3}).replace_infinity({"f": (-1, 1)}).sum("f", -9, 9), [(7.0,)]),
    "replace strings": (lambda q: q.replace_null_and_nan({"s": "z"}).groupby(KeySet.from_dict({"s": ["z", "b"]})).count(), [("b", 2), ("z", 1)]),
    "null key": (lambda q: q.groupby(KeySet.from_tuples([(None,), ("b",)], ["s"])).count(), [("b", 2), (None, 1)]),
    "distinct values": (lambda q: q.count_distinct(["f"]), [(5,)]),
    "bounds leave infinities out": (lambda q: q.get_bounds("f"), [(-1.0, 1.0)]),
    "NaN bin": (lambda q: q.histogram("f", BinningSpec([0.0, 2.0], names=["in"], nan_bin="nan")), [("in", 1), ("nan", 1)]),
}


@pytest.mark.parametrize("name", SPECIAL_CASES)
def test_special_values(special, name):
    make, want = SPECIAL_CASES[name]
    assert answer(special, make(QueryBuilder("t"))) == want


def test_null_safe_joins(spark, budget):
    special = Session.from_dataframe(budget, "t", spark.createDataFrame(SPECIAL, "s string, i long, f double"), AddOneRow())
    public = spark.createDataFrame([(None, math.nan, 1), ("b", math.inf, 2)], "s string, f double, k long")
    assert answer(special, QueryBuilder("t").join_public(public).sum("k", 0, 9)) == [(3,)]
    assert answer(special, QueryBuilder("t").join_public(public, ["s"], how="left").count()) == [(5,)]
    assert answer(special, QueryBuilder("t").join_private("t", TruncationStrategy.DropExcess(2), TruncationStrategy.DropExcess(2), ["s"]).count()) == [(7,)]
    assert answer(special, QueryBuilder("t").join_private("t", TruncationStrategy.DropNonUnique(), TruncationStrategy.DropExcess(2), ["s"]).count()) == [(3,)]


def test_grouping_column(spark, budget):
    df = spark.createDataFrame(ROWS, "A string, B long, X long")
    session = Session.from_dataframe(budget, "t", df, AddMaxRowsInMaxGroups("A", 2, 3))
    with pytest.raises(ValueError, match="grouped by 'A'"):
        session.evaluate(QueryBuilder("t").count(), session.remaining_privacy_budget)
    assert answer(session, QueryBuilder("t").groupby(A3).count()) == [("0", 3), ("1", 1), ("2", 0)]
    with pytest.raises(ValueError, match="grouping column"):
        session.evaluate(QueryBuilder("t").select("X").count(), session.remaining_privacy_budget)


def test_groups(spark):
    everything = ApproxDPBudget.inf()
    session = Session.from_dataframe(everything, "t", spark.createDataFrame(ROWS, "A string, B long, X long"), AddMaxRows(2))
    assert answer(session, QueryBuilder("t").get_groups(["A"])) == [("0",), ("1",)]
    with pytest.raises(RuntimeError, match="auto_partition_selection"):
        QueryBuilder("t").groupby("A")
    with config.features.auto_partition_selection.on():
        assert answer(session, QueryBuilder("t").groupby(["A"]).count()) == [("0", 3), ("1", 1)]
        plan = (KeySetPlan.detect("A") * KeySet.from_dict({"B": [0, 1]})).filter("A <> '1'").union(KeySet.from_tuples([("9", 9)], ["A", "B"]))
        assert answer(session, QueryBuilder("t").groupby(plan).sum("X", 0, 9)) == [("0", 0, 1), ("0", 1, 2), ("9", 9, 0)]
        assert answer(session, QueryBuilder("t").groupby(plan["B"].join(KeySet.from_dict({"B": [1]})) - KeySet.from_dict({"B": [0]})).count()) == [(1, 1)]
        finite = Session.from_dataframe(ApproxDPBudget(9, 0.1), "t", session._tables["t"].df, AddMaxRows(1))
        info = finite._noise_info(QueryBuilder("t").groupby("A").count(), ApproxDPBudget(2, 0.1))
        assert [i["noise_parameter"] for i in info] == [1, 1]
        finite.evaluate(QueryBuilder("t").groupby("A").count_distinct(), ApproxDPBudget(2, 0.1)).collect()
        assert finite.remaining_privacy_budget == ApproxDPBudget(7, 0)


def test_rejected(spark, budget):
    session = Session.from_dataframe(budget, "t", spark.createDataFrame(ROWS, "A string, B long, X long"), AddOneRow())
    b = QueryBuilder("t")
    bad = [
        b.filter("rand() > 0.5").count(), b.filter("EXISTS (SELECT 1)").count(), b.filter("nothing = 1").count(), b.filter("sum(X) > 1").count(),
        b.rename({"A": "B"}).count(), b.select("Q").count(), b.groupby(KeySet.from_dict({"X": [1]})).sum("X", 0, 1), b.sum("A", 0, 1),
        b.groupby(KeySet.from_dict({"A": [1]})).count(), b.enforce(MaxRowsPerID(1)).count(), b.flat_map(lambda r: [], {"q": "INTEGER"}).count(),
        b.map(lambda r: {}, {"A": ColumnDescriptor(ColumnType.VARCHAR)}, augment=True).count(), b.join_private("t").count(), QueryBuilder("other").count(),
        b.replace_null_and_nan({"X": "text"}).count(), b.replace_infinity({"X": (0, 1)}).count(), b.join_public("t").count(),
        b.flat_map_by_id(lambda r: r, {"q": "INTEGER"}).count(), b.groupby(KeySet.from_dict({"A": ["0"]})).count("A"),
    ]
    for query in bad:
        with pytest.raises(ValueError):
            session.evaluate(query, session.remaining_privacy_budget)
    with pytest.raises(ValueError, match="array"):
        Session.from_dataframe(budget, "u", spark.createDataFrame([([1.0],)], "e array<double>"), AddOneRow())
    for make in (lambda: b.sum("X", 1, 1), lambda: b.quantile("X", 2, 0, 1), lambda: b.select(["A", "A"]), lambda: QueryBuilder("no name"), lambda: b.rename({"A": ""})):
        with pytest.raises(ValueError):
            make()


def test_row_functions_see_and_make_every_type(spark, budget):
    import datetime

    row = (1, 2.5, "x", datetime.date(2020, 2, 3), datetime.datetime(2021, 4, 5, 6, 7, 8, 9), None)
    df = spark.createDataFrame([row, (None,) * 6], "i long, f double, s string, d date, t timestamp, n long")
    kinds = {"i2": "INTEGER", "f2": "DECIMAL", "s2": "VARCHAR", "d2": "DATE", "t2": "TIMESTAMP"}

    def same(r):
        assert list(r) == ["i", "f", "s", "d", "t", "n"] and (r["t"] is None or r["t"] == datetime.datetime(2021, 4, 5, 6, 7, 8, 9))
        return {"i2": r["i"], "f2": r["i"], "s2": r["s"], "d2": r["d"], "t2": r["t"]}

    session = Session.from_dataframe(budget, "t", df, AddOneRow())
    session.create_view(QueryBuilder("t").map(same, kinds, augment=True), "v", cache=False)
    got = session._views["v"].df
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(*row, 1, 1.0, "x", row[3], row[4]), (None,) * 11], key=str)
    session.create_view(QueryBuilder("t").flat_map(lambda r: (same(r) for _ in range(30_000)), kinds, max_rows=25_000), "w", cache=False)
    assert session._views["w"].df.count() == 50_000 and session._views["w"].df.where("t2 is null").count() == 25_000


def test_random_tables_as_pandas(spark):
    import numpy as np
    import pandas as pd

    draw = np.random.default_rng(3)
    data = pd.DataFrame({"k": draw.integers(0, 6, 500), "v": draw.integers(-50, 50, 500), "f": draw.normal(0, 10, 500)})
    session = Session.from_dataframe(PureDPBudget.inf(), "t", spark.createDataFrame(data), AddOneRow())
    keys, b, inf = KeySet.from_dict({"k": list(range(6))}), QueryBuilder("t"), PureDPBudget.inf()
    groups = data.assign(v=data.v.clip(-20, 30), f=data.f.clip(-5, 5)).groupby("k")
    for query, want in (
        (b.groupby(keys).sum("v", -20, 30, name="x"), groups.v.sum()),
        (b.groupby(keys).average("f", -5, 5, name="x"), groups.f.mean()),
        (b.groupby(keys).variance("f", -5, 5, name="x"), groups.f.var()),
        (b.groupby(keys).stdev("v", -20, 30, name="x"), groups.v.std()),
        (b.groupby(keys).count_distinct(["v"], name="x"), data.groupby("k").v.nunique()),
    ):
        got = session.evaluate(query, inf).toPandas().set_index("k").x.sort_index()
        assert np.allclose(got, want)


def test_exact_quantiles_are_values(spark):
    import numpy as np

    draw = np.random.default_rng(5)
    values = [*map(float, range(1, 100)), 1e6]
    inf = PureDPBudget.inf()
    session = Session.from_dataframe(inf, "t", spark.createDataFrame([(v,) for v in values], "x double"), AddOneRow())
    assert {session.evaluate(QueryBuilder("t").median("x", 0, 1e6), inf).first()[0] for _ in range(3)} == {50.0}
    groups = {"a": list(draw.normal(0, 1e-3, 400)) + [0.0] * 30, "b": list(draw.lognormal(0, 9, 301)) + [-5e5] * 7, "c": [2.0], None: [-1.5] * 9}
    frame = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, x double")
    session = Session.from_dataframe(inf, "t", frame, AddOneRow())
    keys = KeySet.from_tuples([("a",), ("b",), ("c",), (None,), ("none",)], ["g"])
    for q in (0, 0.01, 0.25, 0.5, 0.75, 0.999, 1):
        got = {r.g: r.m for r in session.evaluate(QueryBuilder("t").groupby(keys).quantile("x", q, -1e5, 1e5, name="m"), inf).collect()}
        want = {g: next(v for k, v in enumerate(sorted(min(max(v, -1e5), 1e5) for v in vs), 1) if k >= q * len(vs)) for g, vs in groups.items()}
        assert got == {**want, "none": 0.0}


def test_names_of_timestamp_bins():
    import datetime

    at = datetime.datetime
    names = lambda *edges: BinningSpec(list(edges)).names
    assert names(at(2020, 1, 1), at(2020, 1, 2, 3, 4)) == ["[2020-01-01 00:00, 2020-01-02 03:04]"]
    assert names(at(2020, 1, 1), at(2020, 1, 1, 0, 0, 5)) == ["[2020-01-01 00:00:00, 2020-01-01 00:00:05]"]
    assert names(at(2020, 1, 1), at(2020, 1, 1, 0, 0, 0, 2000)) == ["[2020-01-01 00:00:00.000, 2020-01-01 00:00:00.002]"]
    assert names(at(2020, 1, 1), at(2020, 1, 1, 0, 0, 0, 2)) == ["[2020-01-01 00:00:00.000000, 2020-01-01 00:00:00.000002]"]
    assert names(datetime.date(2020, 1, 1), datetime.date(2020, 1, 2)) == ["[2020-01-01, 2020-01-02]"] and names("a", "b") == ["['a', 'b']"] and names(1, 2) == ["[1, 2]"]


def test_many_bins(spark):
    import datetime

    values = [None, -1.0, 0.0, 0.5, 1.0, 17.25, 2999.5, 3000.0, 3001.0, math.nan, math.inf, -math.inf]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for right in (True, False):
        for both in (True, False):
            spec = BinningSpec([float(k) for k in range(3001)], right=right, include_both_endpoints=both, nan_bin="nan")
            got = [r.b for r in frame.select(spec.column(frame.x).alias("b")).collect()]
            few = BinningSpec([0.0, 1.0, 17.0, 18.0, 3000.0], right=right, include_both_endpoints=both, nan_bin="nan")
            assert got == [spec(v) for v in values] and [r.b for r in frame.select(few.column(frame.x).alias("b")).collect()] == [few(v) for v in values]
    session = Session.from_dataframe(PureDPBudget.inf(), "t", frame, AddOneRow())
    assert answer(session, QueryBuilder("t").histogram("x", BinningSpec([float(k) for k in range(3001)])).suppress(1)) == [("(17.00, 18.00]", 1), ("(2999.00, 3000.00]", 2), ("[0.00, 1.00]", 3)]
    words = BinningSpec([f"{k:04d}, '\\x" for k in range(50)], names=["", *(f"b,{k}\\ \"" for k in range(48))])
    texts = spark.createDataFrame([(v,) for v in (None, "", "0000, '\\x", "0007, '\\x", "0048, '\\xz", "9")], "s string")
    assert [r.b for r in texts.select(words.column(texts.s).alias("b")).collect()] == [words(r.s) for r in texts.collect()]
    odd = BinningSpec([-math.inf, *(0.1 * k for k in range(60)), 1e300, math.inf], names=list(range(62)))
    got = frame.select(odd.column(frame.x).alias("b")).collect()
    assert [r.b for r in got] == [odd(v) for v in values]
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(k) for k in range(100)]
    frame = spark.createDataFrame([(d,) for d in days], "d date")
    spec = BinningSpec(days[10:60], right=False)
    assert [r.b for r in frame.select(spec.column(frame.d).alias("b")).collect()] == [spec(d) for d in days]


def test_conditions_that_raise_are_refused(spark, budget):
    session = Session.from_dataframe(budget, "t", spark.createDataFrame(ROWS, "A string, B long, X long"), AddOneRow())
    spark.udf.register("leaky", lambda x: True, "boolean")
    for condition in (
        "CASE WHEN A = '1' THEN raise_error('leak') ELSE true END", "assert_true(X < 2) IS NULL", "leaky(X)", "reflect('java.lang.Math', 'abs', X) = 1",
        "java_method('java.lang.System', 'exit', 0) = 1", "element_at(array(1), int(X)) = 1", "size(sequence(1, X, 0)) > 0", "map(A, 1, A, 2)['0'] = 1", "url_decode(A) = '0'",
    ):
        with pytest.raises(ValueError, match="condition"):
            session.evaluate(QueryBuilder("t").filter(condition).count(), session.remaining_privacy_budget)
    assert answer(session, QueryBuilder("t").filter("upper(A) = '0' AND X % 2 = 0 AND coalesce(B, 1) < 5 AND A LIKE '0%' AND A IN ('0', '1')").count()) == [(2,)]


def test_flat_map_by_id_sees_rows_in_order_and_makes_every_type(spark, budget):
    import datetime

    at, day = datetime.datetime(2021, 4, 5, 6, 7, 8, 9), datetime.date(2020, 2, 3)
    data = [(1, "b", 2.5, at, day), (1, "a", None, None, None), (None, "n", math.nan, at, day), (1, "a", 1.0, at, day), (2, None, 0.0, at, day)]
    frame = spark.createDataFrame(data, "id long, s string, f double, t timestamp, d date")
    kinds = {"s2": "VARCHAR", "n": "INTEGER", "f2": "DECIMAL", "t2": "TIMESTAMP", "d2": "DATE"}

    def f(rows):
        assert all(r["t"] in (at, None) for r in rows)
        last = rows[-1]
        return [] if last["id"] == 2 else [{"s2": "".join(r["s"] for r in rows), "n": len(rows), "f2": last["f"], "t2": last["t"], "d2": last["d"]}]

    session = Session.from_dataframe(budget, "t", frame.repartition(3), AddRowsWithID("id"))
    session.create_view(QueryBuilder("t").flat_map_by_id(f, kinds), "v", cache=False)
    got = sorted(map(tuple, session._views["v"].df.collect()), key=str)
    assert got[0] == (1, "aab", 3, 2.5, at, day) and got[1][:3] == (None, "n", 1) and len(got) == 2


def test_quantiles_of_skewed_values_in_wide_bounds(spark):
    values = [(g, float(i * i)) for g in ("a", None) for i in range(300)]
    frame = spark.createDataFrame(values, "g string, x double")
    keys = KeySet.from_tuples([("a",), (None,), ("none",)], ["g"])
    for budget in (PureDPBudget.inf(), PureDPBudget(300)):
        make = Session.Builder().with_privacy_budget(budget).with_private_dataframe("t", frame, AddOneRow())
        session, part = make.build(), PureDPBudget.inf() if budget.is_infinite else PureDPBudget(100)
        got = {r.g: r.m for r in session.evaluate(QueryBuilder("t").groupby(keys).quantile("x", 0.5, 0, 1e9, name="m"), part).collect()}
        assert all(145**2 <= got[g] <= 155**2 for g in ("a", None)) and 0 <= got["none"] <= 1e9
        ((q,),) = session.evaluate(QueryBuilder("t").quantile("x", 0.9, -1e9, 1e9), part).collect()
        assert 265**2 <= q <= 275**2
