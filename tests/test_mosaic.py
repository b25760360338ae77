"""Blending in blocks against whole images, and assembly against a canvas put together in NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import mosaic as M


def whole(a, b, levels):
    """The blend of two whole images with NaN where they show nothing."""
    h, w = a.shape
    ramp = np.arange(w)[None, :] / max(1, w - 1) if w >= h else np.arange(h)[:, None] / max(1, h - 1)
    ramp = np.broadcast_to(ramp, a.shape)
    wa, wb = np.where(np.isfinite(a), 1 - ramp, 0), np.where(np.isfinite(b), ramp, 0)
    t = np.maximum(wa + wb, 1e-6)
    wa, wb = wa / t, wb / t
    return M.blended(np.nan_to_num(a), np.nan_to_num(b), wa, wb, levels if min(h, w) >= M.LEAST_SIDE else 0), wa + wb


def holes(rng, shape, share):
    img = rng.normal(100, 20, shape)
    img[rng.random(shape) < share] = np.nan
    return img


def rows(key, a, b):
    h, w = a.shape
    number = lambda v: float(v) if np.isfinite(v) else None
    return [(key, h, w, y, x, number(a[y, x]), number(b[y, x])) for y in range(h) for x in range(w)]


@pytest.mark.parametrize("block", [8, 16, 24, 512])
@pytest.mark.parametrize("pyramid", [True, False])
def test_blocks_give_what_whole_regions_give(spark, block, pyramid):
    rng = np.random.default_rng(block)
    images = {k: (holes(rng, s, 0.2), holes(rng, s, 0.3)) for k, s in enumerate([(61, 45), (8, 70), (33, 7), (1, 1), (40, 8)])}
    images[5] = (np.full((20, 20), np.nan), np.full((20, 20), np.nan))
    df = spark.createDataFrame([r for k, (a, b) in images.items() for r in rows(k, a, b)], "key int, h long, w long, y long, x long, a double, b double").repartition(7)
    got = {k: (np.full(a.shape, np.nan), np.full(a.shape, np.nan)) for k, (a, _) in images.items()}
    n = 0
    for r in M.blend(df, ["key"], block=block, pyramid=pyramid).collect():
        got[r["key"]][0][r["y"], r["x"]], got[r["key"]][1][r["y"], r["x"]] = r["value"], r["weight"]
        n += 1
    assert n == sum(a.size for a, _ in images.values())
    for k, (a, b) in images.items():
        value, weight = whole(a, b, M.LEVELS if pyramid else 0)
        np.testing.assert_allclose(got[k][0], value, atol=1e-9)
        np.testing.assert_allclose(got[k][1], weight, atol=1e-12)


def test_pyramid_of_one_image_with_itself_gives_it_back():
    img = np.random.default_rng(1).normal(0, 1, (37, 50))
    half = np.full(img.shape, 0.5)
    np.testing.assert_allclose(M.blended(img, img, half, half, M.LEVELS), img, atol=1e-12)


def test_assembly(spark):
    rng = np.random.default_rng(3)
    scene = rng.normal(50, 5, (40, 60))
    tiles = {0: (0, 0, 24, 24), 1: (0, 16, 24, 24), 2: (10, 30, 24, 24), 3: (30, 0, 10, 10)}
    gains = {0: (1.0, 0.0), 1: (1.1, 2.0), 2: (0.9, -3.0), 3: (1.0, 1.0)}
    shown = [(t, y, x, float((scene[y, x] - gains[t][1]) / gains[t][0])) for t, (y0, x0, h, w) in tiles.items() for y in range(y0, y0 + h) for x in range(x0, x0 + w)]
    t = spark.createDataFrame([(k, *v) for k, v in tiles.items()], "tile long, y0 long, x0 long, h long, w long")
    p = spark.createDataFrame(shown, "tile long, y long, x long, value double")
    g = spark.createDataFrame([(k, *v) for k, v in gains.items()], "id long, gain double, offset double")
    out = M.assemble(t, p, cell=24.0, corrections=g, block=8).collect()
    covered = {(y, x) for _, y, x, _ in shown}
    assert {(r["y"], r["x"]) for r in out} == covered
    assert max(abs(r["value"] - scene[r["y"], r["x"]]) for r in out) < 1e-9
    assert {(r["i"], r["j"], r["h"], r["w"]) for r in M.overlaps(t, 24.0).collect()} == {(0, 1, 24, 8), (1, 2, 14, 10)}
    # where two tiles show nothing of their region it is none of theirs; NaN and null are nothing
    blind = p.where(~((F.col("tile").isin(0, 1)) & F.col("x").between(16, 23)))
    out = M.assemble(t, blind.unionByName(spark.createDataFrame([(0, 5, 20, float("nan")), (1, 5, 20, None)], p.schema)), cell=24.0).collect()
    assert not [r for r in out if 16 <= r["x"] < 24 and r["y"] < 24]
    assert M.assemble(t, p.where("false"), cell=24.0).count() == 0
