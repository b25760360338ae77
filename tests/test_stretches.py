"""Samples of overlapping tiles are sent once, in arrays of bounded size."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from lumenfold.operators import calibration, normalize


def test_samples_travel_in_stretches(spark, monkeypatch):
    """An array holds a stretch of places, not a whole tile, and samples of an edge stay where its cuts and fits are told."""
    rows = [(t, p, float(t * 100 + p)) for t in (1, 2, 3) for p in range(-60, 60, t)]
    edges, samples = spark.createDataFrame([(1, 2), (2, 3)], "i long, j long"), spark.createDataFrame(rows, "id long, place long, value double")
    of = {(t, p): v for t, p, v in rows}
    want = {(i, j, v, of[j, p]) for i, j in ((1, 2), (2, 3)) for (t, p), v in of.items() if t == i and (j, p) in of}
    sizes, keep = [], calibration.materialize

    def kept(df, name):
        d = keep(df, name)
        if name == "stretches":
            sizes.extend(r[0] for r in d.select(F.size("places")).collect())
        return d

    monkeypatch.setattr(calibration, "materialize", kept)
    monkeypatch.setattr(calibration, "STRETCH", 16)
    assert {tuple(r) for r in calibration.pair_samples(edges, samples).collect()} == want and max(sizes) <= 16
    fit = lambda: normalize.iterated_regression(calibration.sky_band(calibration.pair_samples(edges, samples), 0.0, 1.0), ["i", "j"])
    monkeypatch.setattr(calibration, "LEAST_SAMPLES", 8)
    few = sorted(tuple(r) for r in fit().collect())
    monkeypatch.setattr(normalize, "BROADCAST_KEYS", 0)
    assert len(few) == 2 and np.allclose(sorted(tuple(r) for r in fit().collect()), few)


def test_samples_stay_where_they_are_until_tiles_are_assembled(spark):
    """Gains come to the samples: these are sent once, summed up by pixel."""
    found = __spark_entry__.queries()["assemble_tiles"](spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = found.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(pixel" in plan
