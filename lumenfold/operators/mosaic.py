"""Blending of overlapping tiles and their assembly, block by block.

A pixel is sent to its block and to every block whose margin it lies in, so a block of ``block`` pixels a side arrives with
the border that its pyramid needs, and the pixels inside it come out as they would from the whole region. Blocks begin
at multiples of the coarsest level's pixels, so every level is cut alike. A region of any size is as many groups, each
of bounded size, and one shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import spatial
from lumenfold.session import materialize, ship

# fixed values: they must equal those of the blending that this one replaces
LEVELS, LEAST_SIDE = 4, 8


def margin(levels: int = LEVELS) -> int:
    """Pixels around a block that its own ones depend on: a level's blur reaches one pixel of the level below, and a coarse
    pixel covers that many fine ones; rounded up to the coarsest pixel."""
    return 2 * 2 ** (levels - 1)


def with_margin(pixels: DataFrame, block: int, border: int) -> DataFrame:
    """Rows (..., h, w, y, x) with the blocks (by, bx) that have or border on the pixel."""
    span = lambda at, size: F.explode(F.sequence(F.floor(F.greatest(F.col(at) - border, F.lit(0)) / block), F.floor(F.least(F.col(at) + border, F.col(size) - 1) / block)))
    return pixels.withColumn("by", span("y", "h")).withColumn("bx", span("x", "w"))


def smoothed(img: np.ndarray) -> np.ndarray:
    """Mean of three by three; a border repeats itself."""
    p = np.pad(img, 1, mode="edge")
    h, w = img.shape
    return sum(p[i : i + h, j : j + w] for i in range(3) for j in range(3)) / 9.0


def gaussian(img: np.ndarray, levels: int) -> list[np.ndarray]:
    out = [img]
    for _ in range(levels - 1):
        out.append(smoothed(out[-1])[::2, ::2])
    return out


def larger(img: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    return np.repeat(np.repeat(img, 2, 0), 2, 1)[: shape[0], : shape[1]]


def shares(valid_a: np.ndarray, valid_b: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of both sides: a ramp over the longer side's places ``at``, of what is valid."""
    wb = np.broadcast_to(at / max(1, length - 1), valid_a.shape) * valid_b
    wa = (1.0 - np.broadcast_to(at / max(1, length - 1), valid_a.shape)) * valid_a
    total = wa + wb
    with np.errstate(invalid="ignore"):
        return np.where(total > 0, wa / np.maximum(total, 1e-6), 0.0), np.where(total > 0, wb / np.maximum(total, 1e-6), 0.0)


def blended(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray, levels: int) -> np.ndarray:
    """Both sides (0 where invalid) by their weights; from ``levels`` of a pyramid, or none."""
    if not levels:
        return (a * wa + b * wb) / np.maximum(wa + wb, 1e-6)
    ga, gb, ma, mb = (gaussian(v, levels) for v in (a, b, wa, wb))
    out = None
    for k in reversed(range(levels)):
        total = np.maximum(ma[k] + mb[k], 1e-6)
        la, lb = (g[k] if k == levels - 1 else g[k] - larger(g[k + 1], g[k].shape) for g in (ga, gb))
        level = (la * ma[k] + lb * mb[k]) / total
        out = level if out is None else larger(out, level.shape) + level
    return out


def blend(patches: DataFrame, keys: list[str], *, pyramid: bool = True, levels: int = LEVELS, block: int = 512) -> DataFrame:
    """(keys, y, x, value, weight) for each row of ``patches`` (keys, h, w, y, x, a, b): what two tiles show at a place of the
    h by w region that both cover. A null or NaN side is invalid there; a place that neither shows has weight 0. Regions with
    a side under ``LEAST_SIDE`` are blended by the ramp alone."""
    ship(patches.sparkSession)
    border = margin(levels)
    if block % 2 ** (levels - 1):
        raise ValueError(f"a block's side must be a multiple of {2 ** (levels - 1)}")
    rows = with_margin(patches, block, border) if pyramid else patches.withColumn("by", F.floor(F.col("y") / block)).withColumn("bx", F.floor(F.col("x") / block))
    kinds = ", ".join(f"{k} {patches.schema[k].dataType.simpleString()}" for k in keys)

    def make(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        h, w = t.column("h")[0].as_py(), t.column("w")[0].as_py()
        by, bx = key[-2].as_py(), key[-1].as_py()
        y0, x0 = max(0, by * block - border), max(0, bx * block - border)
        shape = min(h, by * block + block + border) - y0, min(w, bx * block + block + border) - x0
        y, x = (t.column(c).to_numpy() for c in ("y", "x"))
        sides = np.full((2, *shape), np.nan)
        for side, c in zip(sides, ("a", "b"), strict=True):
            side[y - y0, x - x0] = t.column(c).to_numpy(zero_copy_only=False)
        valid = np.isfinite(sides)
        at, length = (np.arange(x0, x0 + shape[1])[None, :], w) if w >= h else (np.arange(y0, y0 + shape[0])[:, None], h)
        wa, wb = shares(*valid, at, length)
        a, b = np.where(valid, sides, 0.0)
        value = blended(a, b, wa, wb, levels if pyramid and min(h, w) >= LEAST_SIDE else 0)
        own = np.flatnonzero((y // block == by) & (x // block == bx))
        y, x = y[own], x[own]
        out = [pa.array([k.as_py()] * len(own), k.type) for k in key[:-2]]
        return pa.table([*out, pa.array(y, pa.int64()), pa.array(x, pa.int64()), pa.array(value[y - y0, x - x0]), pa.array((wa + wb)[y - y0, x - x0])], names=[*keys, "y", "x", "value", "weight"])

    return rows.groupBy(*keys, "by", "bx").applyInArrow(make, f"{kinds}, y long, x long, value double, weight double")


def overlaps(tiles: DataFrame, cell: float) -> DataFrame:
    """(i, j, y0, x0, h, w) of the regions that two tiles (tile, y0, x0, h, w) share, in whole pixels."""
    side = lambda p, t: tiles.select(F.col("tile").alias(t), F.col("x0").alias(p + "x0"), (F.col("x0") + F.col("w")).alias(p + "x1"), F.col("y0").alias(p + "y0"), (F.col("y0") + F.col("h")).alias(p + "y1"))
    j = spatial.box_join(side("a_", "i"), side("b_", "j"), cell, inclusive=False, extra=F.col("i") < F.col("j"))
    y0, x0 = F.greatest("a_y0", "b_y0"), F.greatest("a_x0", "b_x0")
    return j.select("i", "j", y0.alias("y0"), x0.alias("x0"), (F.least("a_y1", "b_y1") - y0).alias("h"), (F.least("a_x1", "b_x1") - x0).alias("w"))


def patches(pixels: DataFrame, regions: DataFrame) -> DataFrame:
    """(i, j, h, w, y, x, a, b): what the tiles of a region show in it; ``pixels`` are (tile, y, x, value) on the canvas."""
    def side(t: str, v: str) -> DataFrame:
        j = regions.join(pixels.withColumnRenamed("tile", t).withColumnRenamed("y", "py").withColumnRenamed("x", "px"), t)
        inside = (F.col("py") >= F.col("y0")) & (F.col("py") < F.col("y0") + F.col("h")) & (F.col("px") >= F.col("x0")) & (F.col("px") < F.col("x0") + F.col("w"))
        none = F.lit(None).cast("double")
        return j.where(inside).select("i", "j", "h", "w", (F.col("py") - F.col("y0")).alias("y"), (F.col("px") - F.col("x0")).alias("x"), (F.col("value") if v == "a" else none).alias("a"), (F.col("value") if v == "b" else none).alias("b"))

    return side("i", "a").unionByName(side("j", "b")).groupBy("i", "j", "h", "w", "y", "x").agg(F.max("a").alias("a"), F.max("b").alias("b"))


def assemble(tiles: DataFrame, pixels: DataFrame, *, cell: float, corrections: DataFrame | None = None, **how) -> DataFrame:
    """(y, x, value, weight) of the canvas. Tiles are (tile, y0, x0, h, w), pixels (tile, y, x, value) on the canvas, corrections
    (id, gain, offset). Shared regions are blended and weighed in; what a tile shows outside its regions stays as it is. A
    region where nothing is valid is no region: its tiles' pixels count as unshared."""
    shown = pixels.where(F.col("value").isNotNull() & ~F.isnan("value"))
    if corrections is not None:
        shown = shown.join(corrections.select(F.col("id").alias("tile"), "gain", "offset"), "tile").select("tile", "y", "x", (F.col("value") * F.col("gain") + F.col("offset")).alias("value"))
    shown = materialize(shown.select("tile", "y", "x", "value"), "pixels")
    regions = materialize(overlaps(tiles, cell), "regions")
    made = materialize(blend(patches(shown, regions), ["i", "j"], **how), "blended")
    used = made.groupBy("i", "j").agg(F.max("weight").alias("most")).where("most > 0").select("i", "j")
    placed = made.join(regions, ["i", "j"]).select((F.col("y") + F.col("y0")).alias("y"), (F.col("x") + F.col("x0")).alias("x"), "value", "weight")
    within = regions.join(used, ["i", "j"]).select(F.explode(F.array("i", "j")).alias("tile"), "y0", "x0", "h", "w")
    inside = F.col("y").between(F.col("y0"), F.col("y0") + F.col("h") - 1) & F.col("x").between(F.col("x0"), F.col("x0") + F.col("w") - 1)
    shared = shown.join(within, "tile").where(inside).select("tile", "y", "x").distinct()
    alone = shown.join(shared, ["tile", "y", "x"], "left_anti").select("y", "x", "value", F.lit(1.0).alias("weight"))
    total = placed.unionByName(alone).groupBy("y", "x").agg(F.sum(F.col("value") * F.col("weight")).alias("s"), F.sum("weight").alias("weight"))
    return total.where("weight > 0").select("y", "x", (F.col("s") / F.col("weight")).alias("value"), "weight")
