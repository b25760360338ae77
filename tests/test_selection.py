"""Exact quantiles by selection against NumPy: ties, nulls, groups of one value, values of any size."""

from __future__ import annotations

import numpy as np
import pytest

from lumenfold.operators import graph, selection

KIND = "a string, b int, v double"
NAMES = {"low": 0.0, "p1": 0.01, "median": 0.5, "p99": 0.99, "high": 1.0, "again": 0.5}


@pytest.mark.parametrize("cells", [2, 7, 4096])
def test_quantiles_are_exact(spark, cells):
    rng = np.random.default_rng(cells)
    groups = {
        ("x", 1): rng.normal(0, 1, 300), ("x", None): np.round(rng.normal(0, 2, 200)), (None, 1): np.array([5.0]), (None, None): np.array([1e300, -1e300, 0.0, 1e-300]),
        ("y", 2): np.repeat(3.5, 50), ("z", 3): np.concatenate([np.full(90, 7.0), rng.exponential(1e6, 10)]),
    }
    rows = [(*k, float(v)) for k, vs in groups.items() for v in vs] + [("none", 9, None), ("none", 9, float("nan")), ("x", 1, None)]
    df = spark.createDataFrame(rows, KIND).repartition(5)
    got = {(r["a"], r["b"]): [r[n] for n in NAMES] for r in selection.quantiles(df, ["a", "b"], "v", NAMES, cells).collect()}
    assert got.pop(("none", 9)) == [None] * len(NAMES)
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert got[k] == pytest.approx([np.quantile(vs / 2, q) * 2 for q in NAMES.values()], rel=1e-12)
    every = np.concatenate(list(groups.values()))
    one = selection.quantiles(df, [], "v", {"m": 0.5}, cells).collect()
    assert [r["m"] for r in one] == [pytest.approx(np.quantile(every, 0.5))]
    assert [r["m"] for r in selection.quantiles(df.where("false"), [], "v", {"m": 0.5}).collect()] in ([], [None])
    assert selection.quantiles(df.where("false"), ["a"], "v", {"m": 0.5}).count() == 0


def test_beside_keeps_groups_with_null_keys(spark):
    df = spark.createDataFrame([("x", 1, 1.0), (None, 1, 4.0), (None, 2, 6.0)], KIND)
    told = df.groupBy("a").count()
    assert {(r["a"], r["count"], r["m"]) for r in selection.beside(told, df, ["a"], "v", {"m": 0.5}).collect()} == {("x", 1, 1.0), (None, 2, 5.0)}


def test_stars_find_components(spark):
    rng = np.random.default_rng(3)
    n = 400
    edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (260, 2))] + [(i, i + 1) for i in range(n, n + 150)] + [(3, 3)]
    root = list(range(n + 200))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["id"]: r["component"] for r in graph.components(spark.range(n + 200), spark.createDataFrame(edges, "i long, j long")).collect()}
    assert got == {i: find(i) for i in range(n + 200)}
    assert graph.components(spark.range(0), spark.createDataFrame([], "i long, j long")).count() == 0


def test_bounded_location_is_that_of_arrays(spark):
    from lumenfold.operators import robust

    rng = np.random.default_rng(6)
    rows = [(k, float(v), float(w)) for k, n in ((1, 400), (2, 30), (3, 2), (4, 1)) for v, w in zip(np.where(rng.random(n) < 0.1, 90, rng.normal(10, 2, n)), rng.uniform(0.5, 2, n), strict=True)]
    rows += [(5, 7.0, 1.0)] * 6 + [(1, None, 1.0)]
    s = spark.createDataFrame(rows, "k int, value double, weight double").repartition(4)
    cols = ["k", "value", "sigma", "n", "rounds", "clipped_low", "clipped_high"]
    a, b = ({r["k"]: tuple(r)[1:] for r in f(s, ["k"], 2.0, 1.5).select(*cols).collect()} for f in (robust.huber_winsorized, robust.huber_bounded))
    assert a.keys() == b.keys()
    for k in a:
        assert b[k] == pytest.approx(a[k], rel=1e-9), k
