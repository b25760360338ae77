"""Cropping by gates and trimming of tinted borders on made images: one image a gate."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import edges as E

H, W = 90, 100
KIND = "image string, y long, x long, r double, g double, b double"


def image(change=None):
    rng = np.random.default_rng(2)
    img = np.repeat(rng.normal(0.5, 0.02, (H, W, 1)), 3, axis=2) * (1 + rng.normal(0, 0.005, (H, W, 3)))
    if change:
        change(img)
    return img


def frame(spark, images):
    rows = [(n, y, x, *map(float, i[y, x])) for n, i in images.items() for y in range(i.shape[0]) for x in range(i.shape[1])]
    return spark.createDataFrame(rows, KIND).repartition(6)


def left(width, gains):
    def change(img):
        img[:, :width] *= gains

    return change


def top(img):
    img[:8] *= (0.5, 1.0, 0.5)


def fades(img):
    img[:, 0] *= (1.2, 1.0, 1.2)  # cast, but not by enough to begin with
    img[:, 1:9] *= (2.0, 1.0, 2.0)


def cut(spark, images):
    p = frame(spark, images)
    zero = F.lit(0).cast("long")
    boxes = E.sizes(p).select("image", zero.alias("y0"), zero.alias("x0"), F.col("h").alias("y1"), F.col("w").alias("x1"))
    return {r["image"]: (r["y0"], r["x0"], r["y1"], r["x1"]) for r in E.trim_cast(p, boxes).collect()}


def test_trims_begin_far_off_go_on_while_cast_and_stop_at_the_guard(spark):
    both = image(left(6, (2.0, 1.0, 2.0)))
    top(both)
    got = cut(spark, {
        "plain": image(), "left": image(left(6, (2.0, 1.0, 2.0))), "both": both, "wide": image(left(40, (2.0, 1.0, 2.0))), "fades": image(fades),
        "grey": image(left(6, (0.02, 0.01, 0.02))), "small": image()[:60],
    })
    assert got["plain"] == (0, 0, H, W)
    assert got["left"] == (0, 6, H, W)
    assert got["both"] == (9, 6, H, W)  # strips of three
    assert got["wide"] == (0, 9, H, W)  # a tenth of the shorter side, in strips
    assert got["fades"] == (0, 9, H, W)  # the strip counts, not its first column
    assert got["grey"] == (0, 0, H, W)  # off in colour, but not saturated
    assert got["small"] == (0, 0, 60, W)


def dark(img):
    img[:, :20] *= 0.02


def tinted(img):
    img[:40, :24] *= (2.4, 0.6, 0.6)


def crop(spark, images, **how):
    return {r["image"]: (r["y0"], r["x0"], r["y1"], r["x1"]) for r in E.autocrop(frame(spark, images), band=5, margin=2, **how).collect()}


def test_gates_of_the_crop(spark):
    got = crop(spark, {"plain": image(), "dark": image(dark), "tinted": image(tinted), "tiny": image()[:12, :12], "black": np.zeros((H, W, 3))})
    assert got["dark"][1] > 20
    assert got["plain"][1] < 20
    assert got["tinted"] != got["plain"]
    assert got["tiny"] == (2, 2, 10, 10)
    assert got["black"] == (0, 0, H, W)


@pytest.mark.parametrize("wrap", [True, False])
def test_erosion(spark, wrap):
    rng = np.random.default_rng(7)
    mask = rng.random((9, 12)) < 0.8
    cells = spark.createDataFrame([("i", 9, 12, int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)], "image string, gh long, gw long, cy long, cx long")
    p = np.pad(mask, 1, mode="wrap") if wrap else np.pad(mask, 1)
    want = np.all([p[i : i + 9, j : j + 12] for i in range(3) for j in range(3)], axis=0)
    got = np.zeros_like(mask)
    for r in E.eroded(cells, wrap).collect():
        got[r["cy"], r["cx"]] = True
    assert (got == want).all()


def test_feather_against_brute_force_on_made_masks(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for k in range(200):
        h, w = rng.integers(1, 14, 2)
        cover = np.where(rng.random((h, w)) < rng.choice([0.05, 0.3, 0.8]), 0, rng.integers(3, 7, (h, w)))
        shown = rng.random((h, w)) < 0.97
        shown[-1, -1] = True  # an image is as large as its rows say
        rows += [(k, y, x, int(cover[y, x])) for y in range(h) for x in range(w) if shown[y, x]]
        cover = np.where(shown, cover, 0)
        most = cover.max()
        need = max(3.0, 0.4 * most)
        good = cover >= need if most >= need else np.zeros_like(shown)
        bad = np.argwhere(~good)
        margin = max(1.0, 0.3 * min(h, w))
        for y in range(h):
            for x in range(w):
                far = min((np.hypot(*(b - (y, x))) for b in bad), default=np.inf)
                want[k, y, x] = 0.0 if not good[y, x] else 1.0 if far >= margin else (far / margin) ** 0.5
    df = spark.createDataFrame(rows, "image int, y long, x long, cover long").repartition(4)
    got = {(r["image"], r["y"], r["x"]): r["alpha"] for r in E.feather(df, margin_percent=30.0, decay=2.0).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-12


def test_feather_falls_back_to_lower_thresholds(spark):
    df = spark.createDataFrame([("low", 0, 0, 1.0), ("low", 0, 1, 2.0), ("tiny", 0, 0, 0.2), ("tiny", 0, 1, 0.0), ("none", 0, 0, 0.0)], "image string, y long, x long, cover double")
    got = {(r["image"], r["x"]): r["alpha"] for r in E.feather(df, margin_percent=0.0).collect()}
    assert got == {("low", 0): 1.0, ("low", 1): 1.0, ("tiny", 0): 1.0, ("tiny", 1): 0.0, ("none", 0): 0.0}
