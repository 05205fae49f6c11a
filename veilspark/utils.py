"""Upkeep."""

from __future__ import annotations

from .plans import answers


def remove_all_temp_tables() -> None:
    """Deletes the tables that hold fixed answers; answers that were read from them can't be used after."""
    from .keyset import spark_session

    spark = spark_session()
    while answers.SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(answers.SCRATCH.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cleanup() -> None:
    """To be called before Spark is stopped."""
    remove_all_temp_tables()


def check_installation() -> None:
    """Runs a small grouped count from end to end."""
    from . import AddOneRow, KeySet, PureDPBudget, QueryBuilder, Session
    from .keyset import spark_session

    df = spark_session().createDataFrame([("a", 1), ("b", 2)], "name string, value long")
    session = Session.from_dataframe(PureDPBudget(1), "table", df, AddOneRow())
    query = QueryBuilder("table").groupby(KeySet.from_dict({"name": ["a", "b", "c"]})).count()
    rows = session.evaluate(query, PureDPBudget(1)).collect()
    if len(rows) != 3 or session.remaining_privacy_budget != PureDPBudget(0):
        raise RuntimeError("the installation check gave a wrong answer")
    print("Installation check complete.")
