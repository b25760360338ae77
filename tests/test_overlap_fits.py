"""Pairs of overlapping tiles are fitted where their samples are: as pair by pair, and without a row for each sample of a pair."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lumenfold.operators import calibration, normalize, overlaps, spatial

SMALL = "/root/testdata/sf0.001"


def _tiles(spark, n=40):
    rng = random.Random(5)
    boxes = [(3 * k, (x := rng.uniform(-90, 90)), x + rng.uniform(20, 60), (y := rng.uniform(-90, 90)), y + rng.uniform(20, 60)) for k in range(n)] + [(500, None, 1.0, 0.0, 1.0)]
    rows = []
    for k, *_ in boxes:
        start = rng.choice([-3000, 3000, 9000])
        for p in range(start, start + 3000, rng.choice([3, 3, 5])):
            if rng.random() < 0.9:
                rows.append((k, p, (1 + k % 5 / 50) * (50 + 20 * np.sin(p / 30)) + k % 7 + rng.gauss(0, 0.5 if rng.random() < 0.9 else 9)))
    rows += [(1, 5, None), (0, 10**6, float("nan")), (77, 5, 1.0)]
    return spark.createDataFrame(boxes, "id long, x0 double, x1 double, y0 double, y1 double"), spark.createDataFrame([(a, b, None if c is None else float(c)) for a, b, c in rows], "id long, place long, value double")


@pytest.mark.parametrize("block, most", [(1 << 20, 1 << 19), (2000, 1 << 19), (2000, 800)])
def test_fits_in_blocks_are_those_pair_by_pair(spark, monkeypatch, block, most):
    boxes, samples = _tiles(spark)
    for name, value in (("BLOCK", block), ("TILE", 16), ("MOST", most), ("SPAN", 1)):
        monkeypatch.setattr(overlaps, name, value)
    edges = spatial.overlap_pairs(boxes, 40.0, 0.2).select("i", "j", F.col("area").alias("w"))
    want = {(r["i"], r["j"]): r for r in calibration.fit_pairs(edges, samples).collect()}
    rows = calibration.fit_overlaps(boxes, samples, 40.0, 0.2).collect()
    got = {(r["i"], r["j"]): r for r in rows}
    assert len(rows) == len(got) > 10 and set(got) == set(want)
    for k, r in want.items():
        assert (got[k]["a"], got[k]["b"], got[k]["w"], got[k]["n"]) == pytest.approx((r["a"], r["b"], r["w"], r["n"]), abs=1e-7), k


def test_runs_that_say_nothing_are_left_alone():
    run = np.repeat([0, 1, 2, 3], [30, 70, 10, 80])
    x = np.concatenate([np.full(30, 0.1), np.arange(70.0), np.arange(10.0), np.full(80, 7.3)])
    y = np.concatenate([np.arange(30.0), 2 * np.arange(70.0) + 1, np.arange(10.0), np.arange(80.0)])
    held, a, b, n = overlaps.fit_runs(run, x, y, sky=(0.0, 1.0), least=20, least_sky=2, sigma=2.5)
    assert held.tolist() == [0, 1, 3] and np.allclose(a, [1, 2, 1]) and np.allclose(b, [0, 1, 0]) and n.tolist() == [30, 70, 80]
    held, *_ = overlaps.fit_runs(run, x, y, sky=(0.3, 0.7), least=100, least_sky=2, sigma=2.5)
    assert held.size == 0


@pytest.mark.parametrize("name", ["calibration_pairs", "calibration_constraints", "calibration_anchor", "calibration_relaxed"])
def test_no_samples_of_pairs_are_written(spark, monkeypatch, name):
    written = []
    for m in (calibration, normalize):
        keep = m.materialize
        monkeypatch.setattr(m, "materialize", lambda df, at, keep=keep: written.append(at) or keep(df, at))
    __spark_entry__.queries()[name](spark, SMALL).collect()
    assert not {"overlap-samples", "regression"} & set(written)


def test_every_overlapping_pair_is_fitted(spark, tmp_path):
    """Three boxes, of which two share most of each other and the third a corner with both."""
    spark.createDataFrame([(35, 1, 0.0), (70, 1, 110.0), (105, 1, 1100.0)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = [(p, p, k, 1, 9.0, 100.0 + p % 37 + k / 100, "A") for k in (35, 70, 105) for p in range(0, 16 * 100, 16)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {(r["i"], r["j"]) for r in __spark_entry__.queries()["calibration_pairs"](spark, str(tmp_path)).collect()} == {(35, 70), (35, 105), (70, 105)}
