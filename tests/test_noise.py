"""Noise parameters, samplers, budgets and accounting."""

import math
from fractions import Fraction

import numpy as np
import pytest

from veilspark import (
    AddMaxRows,
    AddMaxRowsInMaxGroups,
    AddOneRow,
    AddRowsWithID,
    ApproxDPBudget,
    KeySet,
    MaxGroupsPerID,
    MaxRowsPerGroupPerID,
    MaxRowsPerID,
    PureDPBudget,
    QueryBuilder,
    RhoZCDPBudget,
    Session,
    TruncationStrategy,
)
from veilspark.operators import noise

IDS = [(1, "A", "X", 4), (1, "A", "Y", 5), (1, "A", "X", 6), (2, "A", "Y", 7), (3, "A", "X", 8), (3, "B", "Y", 9)]
PURE, ZCDP = PureDPBudget(1), RhoZCDPBudget(1)
G, G2 = KeySet.from_dict({"g": ["A", "B"]}), KeySet.from_dict({"g2": ["X", "Y"]})


def q(*constraints):
    b = QueryBuilder("ids")
    for c in constraints:
        b = b.enforce(c)
    return b


L0, LINF = MaxGroupsPerID("g", 2), lambda n: MaxRowsPerGroupPerID("g", n)
PARAMETERS = [
    (q(MaxRowsPerID(1)).count(), [1], [0.5]),
    (q(MaxRowsPerID(2)).count(), [2], [2]),
    (q(MaxRowsPerID(5)).count(), [5], [12.5]),
    (q(MaxRowsPerID(1)).average("n", 0, 10), [10, 2], [25, 1]),
    (q(MaxRowsPerID(5)).average("n", 0, 20), [100, 10], [2500, 25]),
    (q(L0, LINF(1)).count(), [2], [2]),
    (q(L0, LINF(1)).groupby(G).count(), [2], [1]),
    (q(L0, LINF(3)).groupby(G).average("n", 0, 10), [60, 12], [450, 18]),
    (q(MaxRowsPerID(5), L0, LINF(3)).groupby(G).count(), [5], [9]),
    (q(MaxRowsPerID(5), L0, LINF(3)).groupby(G2).count(), [5], [12.5]),
    (q(MaxRowsPerID(7)).count_distinct(["id"]), [1], [0.5]),
    (q(MaxRowsPerID(5), MaxRowsPerID(2)).count(), [2], [2]),
]


@pytest.fixture
def ids(spark):
    df = spark.createDataFrame(IDS, "id long, g string, g2 string, n long")
    return lambda budget: Session.from_dataframe(budget, "ids", df, AddRowsWithID("id"))


@pytest.mark.parametrize("number", range(len(PARAMETERS)))
def test_parameters(ids, number):
    query, pure, zcdp = PARAMETERS[number]
    for budget, want in ((PURE, pure), (ZCDP, zcdp)):
        got = [i["noise_parameter"] for i in ids(budget)._noise_info(query, budget)]
        assert got == pytest.approx(want)


def rows(spark, budget, change=None):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 1.5)], "A string, X long, F double")
    return Session.from_dataframe(budget, "t", df, change or AddOneRow())


def test_parameters_of_rows(spark):
    b = QueryBuilder("t")
    info = rows(spark, PureDPBudget(7))._noise_info(b.count(mechanism="LAPLACE"), PureDPBudget(7))
    assert info == [{"noise_mechanism": noise.NoiseMechanism.GEOMETRIC, "noise_parameter": 1 / 7}]
    info = rows(spark, PURE)._noise_info(b.average("X", -111, 234), PURE)
    assert [i["noise_parameter"] for i in info] == [346, 2]  # the middle is rounded up, so values move by 173
    kinds = lambda s, query, budget: [i["noise_mechanism"].name for i in s._noise_info(query, budget)]
    assert kinds(rows(spark, PURE), b.sum("F", 0, 1), PURE) == ["LAPLACE"]
    assert kinds(rows(spark, ZCDP), b.sum("F", 0, 1), ZCDP) == ["GAUSSIAN"]
    assert kinds(rows(spark, ZCDP), b.sum("X", 0, 1), ZCDP) == ["DISCRETE_GAUSSIAN"]
    assert kinds(rows(spark, ZCDP), b.sum("F", 0, 1, mechanism="laplace"), ZCDP) == ["LAPLACE"]
    with pytest.raises(ValueError, match="zCDP"):
        rows(spark, PURE)._noise_info(b.count(mechanism="gaussian"), PURE)
    parameter = lambda s, query, budget=PURE: s._noise_info(query, budget)[0]["noise_parameter"]
    assert parameter(rows(spark, PURE, AddMaxRows(4)), b.sum("X", -3, 2)) == 12
    many = b.flat_map(lambda r: [], {"Z": "INTEGER"}, max_rows=3)
    assert parameter(rows(spark, PURE, AddMaxRows(4)), many.count()) == 12
    split = b.flat_map(lambda r: [], {"Z": "INTEGER"}, augment=True, grouping=True, max_rows=9).groupby(KeySet.from_dict({"Z": [1]}))
    assert parameter(rows(spark, PURE), split.count()) == 9 and parameter(rows(spark, ZCDP), split.count(), ZCDP) == pytest.approx(4.5)
    grouped = AddMaxRowsInMaxGroups("A", 4, 3)
    keys = KeySet.from_dict({"A": ["a"]})
    assert parameter(rows(spark, PURE, grouped), b.groupby(keys).count()) == 12
    assert parameter(rows(spark, ZCDP, grouped), b.groupby(keys).count(), ZCDP) == pytest.approx(18)
    public = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "A string, K long")
    assert parameter(rows(spark, PURE), b.join_public(public).count()) == 2


def test_join_sensitivity_with_unequal_sides(spark):
    builder = Session.Builder().with_privacy_budget(PURE)
    df = spark.createDataFrame([(1, 2)], "k long, v long")
    session = builder.with_private_dataframe("l", df, AddMaxRows(3)).with_private_dataframe("r", df.withColumnRenamed("v", "w"), AddMaxRows(5)).build()
    query = QueryBuilder("l").join_private("r", TruncationStrategy.DropExcess(2), TruncationStrategy.DropExcess(7)).count()
    assert session._noise_info(query, PURE)[0]["noise_parameter"] == 2 * 2 * 5 + 7 * 2 * 3
    query = QueryBuilder("l").join_private("r", TruncationStrategy.DropNonUnique(), TruncationStrategy.DropExcess(7)).count()
    assert session._noise_info(query, PURE)[0]["noise_parameter"] == 1 * 2 * 5 + 7 * 1 * 3


def test_samplers():
    n = 4000
    laplace = np.array([noise.discrete_laplace(Fraction(3)) for _ in range(n)])
    r = math.exp(-1 / 3)
    spread = 2 * r / (1 - r) ** 2
    assert abs(laplace.mean()) < 5 * math.sqrt(spread / n) and abs(laplace.var() / spread - 1) < 0.25
    assert abs((laplace == 0).mean() - (1 - r) / (1 + r)) < 0.03
    gauss = np.array([noise.discrete_gaussian(Fraction(25)) for _ in range(n)])
    assert abs(gauss.mean()) < 5 * 5 / math.sqrt(n) and abs(gauss.var() / 25 - 1) < 0.15
    real = np.array([noise.Noise(noise.NoiseMechanism.LAPLACE, Fraction(1, 2)).add(10.25) for _ in range(n)])
    assert abs(real.mean() - 10.25) < 0.1 and abs(real.var() / 0.5 - 1) < 0.25
    real = np.array([noise.Noise(noise.NoiseMechanism.GAUSSIAN, Fraction(4)).add(-1.0) for _ in range(n)])
    assert abs(real.mean() + 1) < 0.2 and abs(real.var() / 4 - 1) < 0.15
    assert noise.discrete_laplace(Fraction(0)) == noise.discrete_gaussian(Fraction(0)) == 0


def test_sums_of_reals_are_whole_steps(spark):
    values = [0.1, 0.2, 0.3, 1e-9, 4.999, -3.0] * 50
    session = Session.from_dataframe(PureDPBudget(10**9), "t", spark.createDataFrame([(v,) for v in values], "F double"), AddOneRow())
    for query, want in ((QueryBuilder("t").sum("F", -1, 5), sum(max(v, -1) for v in values)), (QueryBuilder("t").average("F", -1, 5), sum(max(v, -1) for v in values) / 300)):
        (got,) = session.evaluate(query, PureDPBudget(10**7)).first()
        assert got == pytest.approx(want, abs=1e-4)
    for per_row in (Fraction(5), Fraction(1, 3), Fraction(10) ** 12):
        n = noise.Noise(noise.NoiseMechanism.LAPLACE, per_row * 7, per_row)
        assert n.grid <= n.parameter / 2**19 and Fraction(math.floor(per_row / n.grid) + 1) * n.grid >= per_row
    # a budget never grows by rounding
    for x in (Fraction(2), Fraction(1, 3), Fraction(10) ** 30, Fraction(1, 10**30), Fraction(0)):
        r = noise.root_below(x)
        assert r * r <= x and (x == 0 or (r * (1 + Fraction(1, 2**50))) ** 2 > x)


def test_a_grouping_flat_map_makes_a_row_for_a_group_once(spark):
    session = rows(spark, ZCDP)
    made = QueryBuilder("t").flat_map(lambda r: [{"g": "a"}] * 5 + [{"g": "b"}, {"g": "a"}, {"g": "c"}], {"g": "VARCHAR"}, augment=True, grouping=True, max_rows=2)
    query = made.groupby(KeySet.from_dict({"g": ["a", "b", "c"]})).count()
    assert session._noise_info(query, ZCDP)[0]["noise_parameter"] == 1  # a row in each of two groups
    exact = rows(spark, RhoZCDPBudget.inf()).evaluate(query, RhoZCDPBudget.inf()).collect()
    assert sorted(map(tuple, exact)) == [("a", 2), ("b", 2), ("c", 0)]


def test_an_answer_is_drawn_once(spark):
    session = rows(spark, PureDPBudget(10))
    for keys in (KeySet.from_dict({"A": ["a", "b"]}), KeySet.from_dataframe(spark.createDataFrame([("a",), ("b",)], "A string"))):
        df = session.evaluate(QueryBuilder("t").groupby(keys).sum("F", 0, 10), PureDPBudget(1))
        assert sorted(df.collect()) == sorted(df.collect()) and df.count() == 2
    from veilspark import utils

    utils.cleanup()
    utils.check_installation()


def test_every_aggregation_under_noise(spark):
    keys = KeySet.from_dict({"A": ["a", "b", "c"]})
    b = QueryBuilder("t").groupby(keys)
    queries = [b.count(), b.count_distinct(), b.sum("X", 0, 5), b.average("F", 0, 5), b.variance("F", 0, 5), b.stdev("X", 0, 5), b.quantile("F", 0.5, 0, 5), b.get_bounds("X"), b.get_bounds("F")]
    for budget in (PureDPBudget(100), RhoZCDPBudget(100), ApproxDPBudget(100, 0.01)):
        session = rows(spark, budget)
        for query in queries:
            got = session.evaluate(query, budget / 20).collect()
            assert [r.A for r in sorted(got)] == ["a", "b", "c"] and all(v is not None for r in got for v in r)
    near = rows(spark, PureDPBudget(10**6)).evaluate(b.sum("X", 0, 5), PureDPBudget(10**6)).collect()
    assert sorted(map(tuple, near)) == [("a", 1), ("b", 2), ("c", 0)]


def test_groups_under_noise(spark):
    df = spark.createDataFrame([("big",)] * 400 + [("one",)], "A string")
    session = Session.from_dataframe(ApproxDPBudget(10, 0.1), "t", df, AddOneRow())
    assert [r.A for r in session.evaluate(QueryBuilder("t").get_groups(), ApproxDPBudget(1, 1e-6)).collect()] == ["big"]
    assert session.remaining_privacy_budget.epsilon == 9
    with pytest.raises(ValueError, match="delta"):
        session.evaluate(QueryBuilder("t").get_groups(), ApproxDPBudget(1, 0))
    with pytest.raises(ValueError, match="ApproxDP"):
        rows(spark, PURE).evaluate(QueryBuilder("t").get_groups(["A"]), PURE)


def test_quantile_mechanism(spark):
    frame = spark.createDataFrame([(k % 30, float(8 * (k // 30))) for k in range(30 * 512)], "g long, x double")
    keys = KeySet.from_dict({"g": [*range(30), *range(100, 120)]})
    session = Session.from_dataframe(PureDPBudget(2), "t", frame, AddOneRow())
    got = {r.g: r.m for r in session.evaluate(QueryBuilder("t").groupby(keys).quantile("x", 0.3, 0, 4096, name="m"), PureDPBudget(2)).collect()}
    assert abs(np.median([got[g] for g in range(30)]) - 0.3 * 4096) < 100 and len({got[g] for g in range(30)}) > 5
    # groups without rows are anywhere between the bounds
    empty = [got[g] for g in range(100, 120)]
    assert all(0 <= m <= 4096 for m in empty) and max(empty) - min(empty) > 500


def test_budgets():
    assert PureDPBudget(1) + PureDPBudget(0.5) == PureDPBudget(1.5) and PureDPBudget(3) / 2 == PureDPBudget(1.5) and 2 * PureDPBudget(1) == PureDPBudget(2)
    assert PureDPBudget(1) + ApproxDPBudget(1, 0.1) == ApproxDPBudget(2, 0.1)
    assert ApproxDPBudget(math.inf, 0) == ApproxDPBudget(1, 1) and ApproxDPBudget.inf().is_infinite
    assert PureDPBudget.inf() - PureDPBudget(5) == PureDPBudget.inf()
    thirds = PureDPBudget(1) / 3
    assert thirds + thirds + thirds == PureDPBudget(1) and hash(thirds * 3) == hash(PureDPBudget(1))
    for bad in (lambda: PureDPBudget(-1), lambda: ApproxDPBudget(1, 2), lambda: PureDPBudget(math.nan), lambda: PureDPBudget(1) - PureDPBudget(2)):
        with pytest.raises(ValueError):
            bad()
    for bad in (lambda: PureDPBudget("1"), lambda: PureDPBudget(1) - ApproxDPBudget(1, 0), lambda: PureDPBudget(1) + RhoZCDPBudget(1), lambda: PureDPBudget(True)):
        with pytest.raises(TypeError):
            bad()


def test_spending(spark):
    session = rows(spark, PureDPBudget(1))
    count = QueryBuilder("t").count()
    session.evaluate(count, PureDPBudget(0.4))
    assert session.remaining_privacy_budget == PureDPBudget(1) - PureDPBudget(0.4)
    with pytest.raises(RuntimeError, match="more privacy budget"):
        session.evaluate(count, PureDPBudget(0.7))
    session.evaluate(count, PureDPBudget(0.6 * (1 + 1e-10)))  # within the tolerance of what is left
    assert session.remaining_privacy_budget == PureDPBudget(0)
    for wrong, error in ((PureDPBudget(0), ValueError), (RhoZCDPBudget(1), TypeError)):
        with pytest.raises(error):
            session.evaluate(count, wrong)
    with pytest.raises(TypeError, match="aggregation"):
        session.evaluate(QueryBuilder("t"), PURE)
    approx = rows(spark, ApproxDPBudget(1, 0.1))
    approx.evaluate(count, ApproxDPBudget(0.5, 0.1))
    assert approx.remaining_privacy_budget == ApproxDPBudget(0.5, 0.1)  # additive noise takes no delta
    approx.evaluate(count, PureDPBudget(0.5))
