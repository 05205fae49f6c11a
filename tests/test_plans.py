"""Physical plans: what reaches the scan, what is shuffled, and where Python runs."""

import re

import pytest

from veilspark import AddOneRow, AddRowsWithID, KeySet, MaxGroupsPerID, MaxRowsPerGroupPerID, MaxRowsPerID, PureDPBudget, QueryBuilder, Session

INF = PureDPBudget.inf()


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("plans") / "t.parquet")
    rows = [(i, i % 7, "abc"[i % 3], float(i), "unused") for i in range(200)]
    spark.createDataFrame(rows, "id long, k long, s string, v double, other string").write.parquet(where)
    return where


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_pruning_and_pushdown(spark, path):
    session = Session.from_dataframe(INF, "t", spark.read.parquet(path), AddOneRow())
    query = QueryBuilder("t").filter("v > 10").groupby(KeySet.from_dict({"s": ["a", "b"]})).sum("v", 0, 50)
    shown = plan(session.evaluate(query, INF))
    assert "ReadSchema: struct<s:string,v:double>" in shown and re.search(r"PushedFilters: \[.*GreaterThan\(v,10.0\)", shown)
    assert "BroadcastHashJoin LeftSemi" in shown or "BroadcastHashJoin\n" in shown
    assert "Python" not in shown and "Arrow" not in shown
    # one shuffle of partial aggregates; the keys join by broadcast
    assert len(re.findall(r"^\(\d+\) Exchange", shown, re.M)) <= 2


def test_truncation_is_limited_before_its_shuffle(spark, path):
    session = Session.from_dataframe(INF, "t", spark.read.parquet(path), AddRowsWithID("k"))
    shown = plan(session.evaluate(QueryBuilder("t").select(["k", "v"]).enforce(MaxRowsPerID(2)).count(), INF))
    assert shown.count("WindowGroupLimit") >= 2 and "ReadSchema: struct<k:bigint,v:double>" in shown
    both = QueryBuilder("t").select(["k", "s"]).enforce(MaxGroupsPerID("s", 2)).enforce(MaxRowsPerGroupPerID("s", 3))
    assert "ReadSchema: struct<k:bigint,s:string>" in plan(session.evaluate(both.count(), INF))


def test_large_key_sets_are_not_broadcast_by_hint(spark, path):
    keys = KeySet.from_dataframe(spark.read.parquet(path).select("id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        session = Session.from_dataframe(INF, "t", spark.read.parquet(path), AddOneRow())
        shown = plan(session.evaluate(QueryBuilder("t").groupby(keys).count(), INF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in shown and "SortMergeJoin" in shown and "CartesianProduct" not in shown
