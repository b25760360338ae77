"""The calibration of tiles: what it undoes, when it falls back, and that order plays no part."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import calibration as C
from lumenfold.operators import normalize

TILES, SIDE = 12, 20


def mosaic(spark, seed=1, noise=0.0):
    """Tiles along a strip, each overlapping the next by half; a scene seen through a gain and an offset of each tile."""
    rng = random.Random(seed)
    scene = {(x, y): float(100 + 30 * np.sin(x / 5) + 20 * np.cos(y / 3)) for x in range(TILES * SIDE) for y in range(SIDE)}
    truth = {t: (1 + rng.uniform(-0.05, 0.05), rng.uniform(-10, 10)) if t else (1.0, 0.0) for t in range(TILES)}
    rows = [(t, x * 1000 + y, (v - truth[t][1]) / truth[t][0] + rng.gauss(0, noise)) for (x, y), v in scene.items() for t in range(TILES) if t * SIDE / 2 <= x < t * SIDE / 2 + SIDE]
    boxes = [(t, t * SIDE / 2, t * SIDE / 2 + SIDE, 0.0, float(SIDE)) for t in range(TILES)]
    rng.shuffle(rows)
    rng.shuffle(boxes)
    return spark.createDataFrame(boxes, "id long, x0 double, x1 double, y0 double, y1 double"), spark.createDataFrame(rows, "id long, place long, value double").repartition(5), truth


def solution(c):
    return {r["id"]: (r["gain"], r["offset"]) for r in c.solution.collect()}


def brought_together(found, truth):
    """Largest difference between tiles of what a calibrated scene of 80 to 120 shows."""
    seen = [[found[t][0] * (v - truth[t][1]) / truth[t][0] + found[t][1] for v in (80, 100, 120)] for t in truth]
    return np.ptp(np.array(seen), axis=0).max()


def test_calibration_brings_tiles_together(spark):
    boxes, samples, truth = mosaic(spark)
    c = C.calibrate(boxes, samples, cell=SIDE, weights=boxes.select("id", F.when(F.col("id") == 4, 9.0).otherwise(1.0).alias("weight")), ridge=1e-6)
    assert (c.status, c.threshold, c.raw, c.kept, c.anchor) == ("solved-affine", 0.05, 11, 11, 4)
    found = solution(c)
    assert brought_together({t: (1.0, 0.0) for t in truth}, truth) > 10
    assert brought_together(found, truth) < 0.05
    assert found[4] == pytest.approx((1.0, 0.0), abs=1e-4)
    again = solution(C.calibrate(boxes.orderBy(F.desc("id")), samples.orderBy("value"), cell=SIDE, weights=boxes.select("id", F.when(F.col("id") == 4, 9.0).otherwise(1.0).alias("weight")), ridge=1e-6))
    assert {k: pytest.approx(v, abs=1e-6) for k, v in found.items()} == again


def test_ladder_takes_the_highest_rung_that_holds(spark):
    pairs = spark.createDataFrame([(0.02,), (0.025,), (0.011,)], "fraction double")
    take = lambda base, **k: tuple(C.ladder(pairs, base, **k).first())
    assert take(0.05) == (0.02, 2)
    assert take(0.022) == (0.022, 1)
    assert take(0.5, steps=(0.4,)) == (None, None)
    assert take(0.005) == (0.005, 3)
    assert tuple(C.ladder(pairs.where("false"), 0.05).first()) == (None, None)


def test_chain_of_solvers(spark):
    boxes, samples, truth = mosaic(spark, 2)
    run = lambda **k: C.calibrate(boxes, samples, cell=SIDE, **k)
    assert run(solvers=("offsets",)).status == "solved-offsets"
    relaxed = run(solvers=("relaxation",))
    assert relaxed.status == "solved-relaxation"
    assert brought_together(solution(relaxed), truth) < brought_together({t: (1.0, 0.0) for t in truth}, truth)
    # neither of the first two may converge in no round at all
    assert run(dense=0, max_rounds=0).status == "solved-relaxation"
    # no pair within the limits, and none that widened ones keep either
    nothing = C.constrain(spark.createDataFrame([(1, 2, float("nan"), 1.0, 1.0, 50)], "i long, j long, a double, b double, w double, n long"))
    assert [r["reason"] for r in nothing.collect()] == ["non-finite"]
    unsolved = run(solvers=())
    assert unsolved.status == "unsolved"
    assert set(solution(unsolved).values()) == {(1.0, 0.0)}
    alone = C.calibrate(boxes.where("id % 3 = 0"), samples, cell=SIDE)
    assert alone.status == "global-median"
    m = {r["id"]: r["m"] for r in samples.where("id % 3 = 0").groupBy("id").agg(F.median("value").alias("m")).collect()}
    middle = np.median(list(m.values()))
    assert solution(alone) == {t: (pytest.approx(middle / v), 0.0) for t, v in m.items()}
    assert C.calibrate(boxes, samples.where("place < 0"), cell=SIDE).status == "no-fits"


def test_limits_widen_only_where_nothing_is_kept(spark):
    rows = [(i, i + 1, a, b, 1.0, 99) for i, (a, b) in enumerate([(1.0, 0.0), (3.0, 0.0), (1.1, 9000.0), (0.0, 1.0)])]
    kind = "i long, j long, a double, b double, w double, n long"
    reasons = lambda r: [x["reason"] for x in C.constrain(spark.createDataFrame(r, kind)).orderBy("i").collect()]
    assert reasons(rows) == ["kept", "gain", "offset", "gain"]
    assert reasons([(i, i + 1, 5.0 + i / 100, 1.0, 1.0, 99) for i in range(200)]).count("kept") > 190


def test_pruning_keeps_components(spark):
    n = 12
    edges = [(i, j, 100.0 - abs(i - j)) for i in range(n) for j in range(i + 1, n) if (i < 6) == (j < 6)] + [(0, 11, 1.0), (5, 6, 2.0)]
    nodes = spark.range(n)
    kept = C.prune(nodes, spark.createDataFrame(edges, "i long, j long, w double"), 1)
    found = {(r["i"], r["j"]) for r in kept.collect()}
    assert (5, 6) in found
    assert (0, 11) not in found
    assert len(found) < len(edges)
    assert C.prune(nodes, spark.createDataFrame(edges, "i long, j long, w double"), 8).count() == len(edges)


def numpy_fit(x, y, sigma, rounds, least, stop):
    if len(x) < least:
        return 1.0, 0.0, len(x)
    k = np.ones(len(x), bool)
    a, b = np.polyfit(x, y, 1)
    for _ in range(rounds):
        r = y - a * x - b
        s = r[k].std()
        new = k & (np.abs(r) <= sigma * s)
        if s <= 1e-6 or new.sum() < stop:
            break
        k = new
        a, b = np.polyfit(x[k], y[k], 1)
    return a, b, k.sum()


def test_iterated_regression_follows_numpy(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for key, n in enumerate([400, 60, 15, 20]):
        x = rng.normal(50, 10, n)
        y = 1.2 * x + 3 + rng.normal(0, 1, n) + np.where(rng.random(n) < 0.1, 40, 0)
        rows += [(key, float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(key, None, 1.0)]
        want[key] = numpy_fit(x, y, 2.0, 6, 16, 8)
    rows += [(9, None, None), (8, 1.0, 1.0)] + [(7, 5.0, float(i)) for i in range(30)]
    found = {r[0]: tuple(r)[1:] for r in normalize.iterated_regression(spark.createDataFrame(rows, "k int, x double, y double"), ["k"], sigma=2.0).collect()}
    for key, (a, b, n) in want.items():
        assert found[key] == (pytest.approx(a, abs=1e-6), pytest.approx(b, abs=1e-4), n)
    assert found[9] == (1.0, 0.0, 0)
    assert found[8] == (1.0, 0.0, 1)
    assert found[7][:2] == (1.0, 0.0)
