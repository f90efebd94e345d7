"""Joint transport between the arms: closed forms, brute force, bounds and odd rows."""

import itertools

import numpy as np
import pytest

from mirador.metrics.transport import joint_transport, scaled_plan

SCHEMA = "v array<double>, t int"


def arms(spark, treated, control):
    rows = [(x.tolist(), 1) for x in treated] + [(x.tolist(), 0) for x in control]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("size,seed", [(1, 0), (4, 1), (6, 2), (7, 3)])
def test_plan_against_every_assignment(size, seed):
    rng = np.random.default_rng(seed)
    cost = rng.random((size, size)) * 10
    even = np.full(size, 1 / size)
    want = min(cost[range(size), p].mean() for p in map(list, itertools.permutations(range(size))))
    most, least = scaled_plan(cost, even, even)
    assert least - 1e-9 <= want <= most + 1e-9
    assert most - least < 0.02 * want + 1e-9


def test_plan_in_one_dimension():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=250), rng.normal(1.0, 2.0, size=250)
    even = np.full(250, 1 / 250)
    want = ((np.sort(x) - np.sort(y)) ** 2).mean()
    most, least = scaled_plan((x[:, None] - y) ** 2, even, even)
    assert least - 1e-9 <= want <= most + 1e-9 and most == pytest.approx(want, rel=0.02)


def test_shift_of_all_rows(spark):
    """The distance between rows and the same rows moved is the length of the move."""
    rng = np.random.default_rng(3)
    base, move = rng.normal(size=(250, 3)), np.array([1.0, -2.0, 0.5])
    got = joint_transport(arms(spark, base + move, base), "v", 3, "t").first()
    assert got["w2_squared"] == pytest.approx(move @ move, rel=0.01)
    assert got["lower"] - 1e-9 <= move @ move <= got["upper"] + 1e-9
    assert (got["n1"], got["n0"], got["cells1"], got["cells0"]) == (250, 250, 250, 250)


def test_cells_bound_the_distance_of_many_rows(spark):
    rng = np.random.default_rng(4)
    base, move = rng.normal(size=(3000, 2)), np.array([3.0, 1.0])
    got = joint_transport(arms(spark, base + move, base), "v", 2, "t", cells=64).first()
    assert got["cells1"] <= 64 and got["cells0"] <= 64
    assert got["lower"] <= move @ move <= got["upper"]
    assert got["w2_squared"] == pytest.approx(move @ move, rel=0.05)


def test_odd_rows(spark):
    rows = [
        ([0.0, 0.0], 1), ([3.0, 4.0], 0), (None, 1), ([1.0], 0), ([1.0, None], 1), ([1.0, float("nan")], 0),
        ([1.0, float("inf")], 0), ([9.0, 9.0], None), ([9.0, 9.0], 2),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = joint_transport(df, "v", 2, "t").first()
    assert (got["w2_squared"], got["n1"], got["n0"]) == (pytest.approx(25.0), 1, 1)
    same = joint_transport(df.filter("t = 1").unionByName(df.filter("t = 1").selectExpr("v", "0 AS t")), "v", 2, "t")
    assert same.first()["w2_squared"] == 0
    for part in (df.filter("t = 1"), df.limit(0)):
        alone = joint_transport(part, "v", 2, "t").first()
        assert alone["w2_squared"] is None and alone["upper"] is None and alone["n0"] == 0


def test_repeated_rows_share_cells(spark):
    """Two points, each repeated far beyond the cells, a third of one arm's mass to be moved."""
    treated = np.repeat([[0.0, 0.0], [2.0, 0.0]], [600, 300], axis=0)
    control = np.repeat([[0.0, 0.0], [2.0, 0.0]], [300, 600], axis=0)
    got = joint_transport(arms(spark, treated, control), "v", 2, "t", cells=8).first()
    assert got["w2_squared"] == pytest.approx(4 / 3, rel=0.01)
    assert got["upper"] - got["lower"] < 0.05 and got["cells1"] == 2
