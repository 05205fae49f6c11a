"""Views, parts, descriptions, key sets and bins."""

import datetime
import warnings

import pytest
from pyspark.sql import functions as F

from veilspark import (
    AddMaxRows,
    AddOneRow,
    AddRowsWithID,
    BinningSpec,
    ColumnType,
    KeySet,
    MaxGroupsPerID,
    MaxRowsPerID,
    PureDPBudget,
    QueryBuilder,
    RhoZCDPBudget,
    Session,
)

INF = PureDPBudget.inf()


@pytest.fixture
def session(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v long")
    return Session.from_dataframe(PureDPBudget(8), "t", df, AddOneRow())


def test_views(session):
    session.create_view(QueryBuilder("t").filter("v > 1"), "large", cache=True)
    session.create_view(QueryBuilder("large").select("v"), "values", cache=False)
    assert session.private_sources == ["t", "large", "values"] and list(session.get_schema("values")) == ["v"]
    assert session.evaluate(QueryBuilder("values").count(), PureDPBudget(1)).count() == 1
    session.delete_view("large")
    with pytest.raises(KeyError):
        session.delete_view("large")
    for name in ("t", "values"):
        with pytest.raises(ValueError, match="already"):
            session.create_view(QueryBuilder("t"), name, cache=False)
    with pytest.raises(TypeError):
        session.create_view(QueryBuilder("t").count(), "x", cache=False)


def test_parts_are_used_in_order(session):
    parts = session.partition_and_create("t", PureDPBudget(3), "k", {"first": "a", "second": "b"})
    assert session.remaining_privacy_budget == PureDPBudget(5) and parts["first"].remaining_privacy_budget == PureDPBudget(3)
    parts["first"].evaluate(QueryBuilder("first").count(), PureDPBudget(1))
    parts["second"].evaluate(QueryBuilder("second").count(), PureDPBudget(3))
    with pytest.raises(RuntimeError, match="any more"):
        parts["first"].evaluate(QueryBuilder("first").count(), PureDPBudget(1))
    with pytest.warns(RuntimeWarning):
        session.evaluate(QueryBuilder("t").count(), PureDPBudget(1))
    with pytest.raises(RuntimeError, match="any more"):
        parts["second"].evaluate(QueryBuilder("second").count(), PureDPBudget(1))
    session.stop()
    with pytest.raises(RuntimeError, match="stopped"):
        session.evaluate(QueryBuilder("t").count(), PureDPBudget(1))


def test_parts_of_id_tables(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "b", 4)], "id long, k string, v long")

    def split(*constraints, budget=PureDPBudget(4)):
        s = Session.from_dataframe(budget, "t", df, AddRowsWithID("id"))
        b = QueryBuilder("t")
        for c in constraints:
            b = b.enforce(c)
        s.create_view(b, "v", cache=False)
        return s.partition_and_create("v", budget, "k", {"x": "a", "y": "b"})

    by_rows = split(MaxRowsPerID(2))["x"]
    assert by_rows.get_id_column("x") is None and by_rows._noise_info(QueryBuilder("x").count(), PureDPBudget(4))[0]["noise_parameter"] == 0.5
    by_groups = split(MaxGroupsPerID("k", 2))["y"]
    assert by_groups.get_id_column("y") == "id" and by_groups.remaining_privacy_budget == PureDPBudget(2)
    with pytest.raises(RuntimeError, match="MaxGroupsPerID"):
        split()
    zcdp = split(MaxGroupsPerID("k", 2), budget=RhoZCDPBudget(4))["y"]
    assert zcdp.remaining_privacy_budget == RhoZCDPBudget(2)


def test_descriptions(session, capsys):
    session.add_public_dataframe("p", session._tables["t"].df.limit(1))
    session.describe()
    session.describe("t")
    session.describe(QueryBuilder("t").groupby(KeySet.from_dict({"k": ["a"]})).count())
    said = capsys.readouterr().out
    assert "hides 1 rows" in said and "INTEGER" in said and "KeySet(k: VARCHAR; at most 1 keys)" in said
    assert session.public_sources == ["p"] and session.get_column_types("p") == {"k": ColumnType.VARCHAR, "v": ColumnType.INTEGER}
    assert session.get_grouping_column("t") is None and session.get_id_space("t") is None


def test_builders(spark):
    df = spark.createDataFrame([(1,)], "id long")
    with pytest.raises(ValueError, match="budget"):
        Session.Builder().with_private_dataframe("t", df, AddOneRow()).build()
    with pytest.raises(ValueError, match="private table"):
        Session.Builder().with_privacy_budget(INF).build()
    with pytest.raises(ValueError, match="already"):
        Session.Builder().with_private_dataframe("t", df, AddOneRow()).with_public_dataframe("t", df)
    with pytest.raises(ValueError, match="ID space"):
        Session.Builder().with_privacy_budget(INF).with_private_dataframe("t", df, AddRowsWithID("id")).with_private_dataframe("u", df, AddMaxRows(1)).build()
    b = QueryBuilder("t")
    assert b.filter("id > 0").count() == b.clone().filter("id > 0").count() and b.count() != b.count("other")
    assert b.map(lambda r: {"x": r["id"] + 1}, {"x": "INTEGER"}).count() == b.map(lambda r: {"x": r["id"] + 1}, {"x": "INTEGER"}).count()
    assert b.map(lambda r: {"x": r["id"] + 1}, {"x": "INTEGER"}).count() != b.map(lambda r: {"x": r["id"] + 2}, {"x": "INTEGER"}).count()
    one, two = (b.groupby(KeySet.from_dict({"id": [1, 2]})).count(), b.groupby(KeySet.from_tuples([(2,), (1,)], ["id"])).count())
    assert one._is_equivalent(two) and hash(one) == hash(two)


def rows(keys):
    return sorted(map(tuple, keys.dataframe().collect()), key=str)


def test_key_sets(spark):
    ab = KeySet.from_tuples([(1, "x"), (1, "x"), (2, None)], ["a", "b"])
    c = KeySet.from_dict({"c": [datetime.date(2020, 1, 1), datetime.date(2021, 1, 1)]})
    frame = KeySet.from_dataframe(spark.createDataFrame([(1, 5), (1, 5), (3, None)], "a int, d long"))
    assert ab.size() == 2 and (ab * c).size() == 4 and frame.size() == 2
    assert rows(ab.join(frame)) == [(1, "x", 5)]
    assert rows((ab * c)["b"]) == [("x",), (None,)] and (ab * c)["b"].size_bound() == 2
    assert rows(ab - KeySet.from_tuples([(None,), ("q",)], ["b"])) == [(1, "x")]
    assert rows((frame * c["c"]) - KeySet.from_dict({"a": [1]})) == [(3, None, datetime.date(2020, 1, 1)), (3, None, datetime.date(2021, 1, 1))]
    assert rows(ab.union(KeySet.from_tuples([("y", 9)], ["b", "a"]))) == [(1, "x"), (2, None), (9, "y")]
    assert rows(ab.filter("a > 1")) == rows(ab.filter(F.col("a") > 1)) == [(2, None)]
    empty = frame.filter("a > 100")
    assert rows((empty * c)["c"]) == [] and rows((frame * c)["c"]) == rows(c)
    assert (ab * c) == (c * ab) and ab != c and (ab * c).is_equivalent(c * ab) and frame.is_equivalent(KeySet.from_dataframe(frame.dataframe())) is None
    assert frame == KeySet.from_dataframe(frame.dataframe()) and len((frame * c).decompose()) == 2
    total = KeySet.from_dict({})
    assert total.size() == 1 and total.dataframe().count() == 0 and (total * ab) == ab and total.columns() == []
    big = KeySet.from_dict({"i": list(range(300))}) * KeySet.from_dict({"j": [f"s{k}" for k in range(300)]}) * KeySet.from_tuples([(1,), (None,)], ["n"])
    assert big.dataframe().count() == big.size() == 180_000 and big.dataframe().distinct().count() == 180_000
    big.cache()
    big.uncache()
    assert KeySet.from_pandas(ab.to_pandas()) == ab
    for bad in (
        lambda: KeySet.from_tuples([], ["a"]), lambda: KeySet.from_tuples([(1,), ("a",)], ["a"]), lambda: KeySet.from_tuples([(None,)], ["a"]), lambda: KeySet.from_dict({"a": [1.5]}),
        lambda: ab * ab, lambda: ab.join(c), lambda: c - ab, lambda: ab.union(c), lambda: ab["z"], lambda: ab - KeySet.from_dict({"a": ["x"]}),
        lambda: KeySet.from_dataframe(spark.createDataFrame([(1.0,)], "a double")),
    ):
        with pytest.raises(ValueError):
            bad()


def test_bins():
    assert BinningSpec([0, 10, 25]).names == ["[0, 10]", "(10, 25]"] and BinningSpec([0.0, 1.0], right=False, include_both_endpoints=False).names == ["[0.00, 1.00)"]
    assert BinningSpec([0.001, 0.002, 0.003]).names[0].startswith("[0.001")
    spec = BinningSpec([0, 1, 2], names=["x", "x"])
    assert spec.bins() == ["x"] and spec(0) == "x" and spec(3) is None and spec(None) is None
    assert BinningSpec([datetime.date(2020, 1, 1), datetime.date(2021, 1, 1)])(datetime.date(2020, 5, 5)) == "[2020-01-01, 2021-01-01]"
    for bad in (lambda: BinningSpec([1]), lambda: BinningSpec([1, 1]), lambda: BinningSpec([1, "a"]), lambda: BinningSpec([1, 2], names=["a", "b"]), lambda: BinningSpec(["a", "b"], nan_bin="n")):
        with pytest.raises(ValueError):
            bad()


def test_warnings(spark):
    df = spark.createDataFrame([(1, None)], "id long, v long")
    s = Session.from_dataframe(INF, "t", df, AddRowsWithID("id"))
    with pytest.warns(RuntimeWarning, match="ID"):
        s.evaluate(QueryBuilder("t").drop_null_and_nan().enforce(MaxRowsPerID(1)).count(), INF)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        s.evaluate(QueryBuilder("t").replace_null_and_nan({"v": 1}).enforce(MaxRowsPerID(1)).count(), INF)


def test_registered_queries_without_the_optional_parts():
    import __spark_entry__ as entry

    core = entry.import_module("veilspark.queries")
    assert set(core.ORACLES) <= set(core.QUERIES) and "count_grouped_keyset" in entry.queries()


def test_decomposition_and_equivalence_of_key_sets(spark):
    ab, c = KeySet.from_tuples([(1, 2), (3, 4)], ["a", "b"]), KeySet.from_dataframe(spark.createDataFrame([("x",), ("y",)], "c string"))
    bd = KeySet.from_dataframe(spark.createDataFrame([(2, 7), (4, 8)], "b long, d long"))
    less = (ab * c) - KeySet.from_dict({"c": ["x"]})
    factors, subtracted = less.decompose_with()
    assert sorted(f.columns() for f in factors) == [["a", "b"], ["c"]] and [s.columns() for s in subtracted] == [["c"]]
    again = factors[0] * factors[1]
    for s in subtracted:
        again = again - s
    assert again == less and less.size() == 2
    joined = ab.join(bd)
    assert [f.columns() for f in joined.decompose_with()[0]] == [["a", "b", "d"]]
    assert sorted(f.columns() for f in joined.decompose_with(["b"])[0]) == [["a", "b"], ["b", "d"]]
    with pytest.raises(ValueError):
        joined.decompose_with(["z"])
    # told without a job: the order of factors, columns and sides does not count
    assert (ab * c).is_equivalent(c * ab) is True and (ab * c).is_equivalent((c * ab)[["c", "b", "a"]]) is True
    assert less.is_equivalent((c * ab) - KeySet.from_dict({"c": ["x"]})) is True and joined.is_equivalent(bd.join(ab)) is True
    assert (ab * c).is_equivalent(KeySet.from_tuples([(1, 2)], ["a", "b"]) * c) is None and less.is_equivalent(ab * c) is None
    big = KeySet.from_dict({"x": list(range(400)), "y": list(range(400))})
    assert big.is_equivalent(KeySet.from_dict({"y": list(range(400)), "x": list(range(400))})) is True and big.is_equivalent(KeySet.from_dict({"y": list(range(400)), "x": list(range(1, 401))})) is False
    assert ab.filter("a > 1").is_equivalent(ab.filter("a > 1")) is True and ab.filter("a > 1").is_equivalent(ab) is None
    assert "keys" in Session.from_dataframe(PureDPBudget(1), "t", spark.createDataFrame([(1, 2)], "a long, b long"), AddOneRow())._describe(QueryBuilder("t").groupby(ab).count())
