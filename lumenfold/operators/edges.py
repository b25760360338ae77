"""Boxes of images: the crop that a pooled grid suggests, and tinted borders trimmed strip by strip.

Pixels are rows (image, y, x, r, g, b). An image's statistics, its pooled cells and its strips are one aggregation each, of all
images at once; nothing holds an image whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import materialize, ship

# fixed values: they must equal those of the cropping that this one replaces
CHROMA, EDGE, LEAST_BASE, AGAIN = 0.18, 24, 0.03, 0.25
CAST, MADS, START, SATURATION = 0.12, 6.0, 2.5, 0.05


def sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def pooled(pixels: DataFrame, band: int) -> DataFrame:
    """(image, h, w, cy, cx, l, v, r, g, b): means of whole cells, and the variance of luminance, each plane stretched to 0 .. 1."""
    up = lambda c: F.greatest(F.col(c), F.lit(0.0))
    rows = pixels.select("image", "y", "x", *[up(c).alias(c) for c in "rgb"]).withColumn("l", (F.col("r") + F.col("g") + F.col("b")) / 3)
    at = rows.groupBy("image").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), *[f(c).alias(n + c) for c in "lrgb" for f, n in ((F.min, "lo_"), (F.max, "hi_"))])
    one = lambda c: F.when(F.col("hi_" + c) > F.col("lo_" + c), (F.col(c) - F.col("lo_" + c)) / (F.col("hi_" + c) - F.col("lo_" + c))).otherwise(0.0)
    j = rows.join(at, "image").select("image", "h", "w", F.floor(F.col("y") / band).alias("cy"), F.floor(F.col("x") / band).alias("cx"), *[one(c).alias(c) for c in "lrgb"])
    whole = (F.col("cy") < F.floor(F.col("h") / band)) & (F.col("cx") < F.floor(F.col("w") / band))
    return j.where(whole).groupBy("image", "h", "w", "cy", "cx").agg(F.avg("l").alias("l"), F.var_pop("l").alias("v"), *[F.avg(c).alias(c) for c in "rgb"])


def eroded(cells: DataFrame, wrap: bool) -> DataFrame:
    """The cells (image, gh, gw, cy, cx) whose eight neighbours are cells too; around the border, or not beyond it."""
    s = cells.withColumn("dy", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dx", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    y, x = F.col("cy") + F.col("dy"), F.col("cx") + F.col("dx")
    if wrap:
        y, x = F.pmod(y, F.col("gh")), F.pmod(x, F.col("gw"))
    n = s.select("image", "gh", "gw", y.alias("cy"), x.alias("cx")).groupBy("image", "gh", "gw", "cy", "cx").agg(F.count(F.lit(1)).alias("n")).where("n = 9")
    return n.select("image", "gh", "gw", "cy", "cx")


def autocrop(pixels: DataFrame, *, band: int = 32, k: float = 2.0, margin: int = 8) -> DataFrame:
    """(image, y0, x0, y1, x1). Gates of a cell: bright enough, not black, not dim and flat; bright enough alone where that leaves
    few; not in a tinted patch of the border; inside what remains. An image too small for three cells loses its margin
    alone, one without a cell or with too small a box nothing."""
    cells = materialize(pooled(pixels, band), "pooled").withColumn("gh", F.floor(F.col("h") / band)).withColumn("gw", F.floor(F.col("w") / band))
    p = lambda c, *qs: F.percentile(c, F.array(*map(F.lit, qs)))
    at = cells.groupBy("image").agg(F.median("l").alias("med"), F.stddev_pop("l").alias("sd"), p("l", 0.005, 0.02, 0.05).alias("pl"), p("v", 0.01, 0.05).alias("pv"))
    eps = F.greatest(F.lit(1e-6), F.col("pl")[0])
    at = at.select("image", eps.alias("eps"), F.greatest(F.col("med") - k * F.greatest("sd", F.lit(1e-6)), F.col("pl")[2], eps).alias("bright"), F.greatest(F.col("pl")[1], eps).alias("dim"), F.greatest(F.col("pv")[1], F.when(F.col("pv")[0] == 0, 1e-6).otherwise(F.col("pv")[0])).alias("flat"))
    c = cells.join(at, "image")
    shown = (F.col("r") > F.col("eps")) | (F.col("g") > F.col("eps")) | (F.col("b") > F.col("eps"))
    base = shown & (F.col("l") >= F.col("bright")) & ~((F.col("l") <= F.col("dim")) & (F.col("v") <= F.col("flat")))
    border = -(-max(EDGE, margin) // band)
    tint = (F.greatest("r", "g", "b") - F.least("r", "g", "b") > CHROMA) & ((F.col("cy") < border) | (F.col("cx") < border) | (F.col("cy") >= F.col("gh") - border) | (F.col("cx") >= F.col("gw") - border))
    c = materialize(c.select("image", "h", "w", "gh", "gw", "cy", "cx", base.alias("base"), (shown & (F.col("l") >= F.col("dim"))).alias("relaxed"), tint.alias("tint")), "gates")
    share = c.groupBy("image").agg(F.avg(F.col("base").cast("double")).alias("share"))
    kept = c.join(share, "image").where(F.when(F.col("share") < LEAST_BASE, F.col("relaxed")).otherwise(F.col("base"))).select("image", "gh", "gw", "cy", "cx")
    cell = ["image", "gh", "gw", "cy", "cx"]
    tinted = eroded(eroded(c.where("tint").select(*cell), False), False)
    once = materialize(eroded(kept.join(tinted, cell, "left_anti"), True), "inside")
    full = once.groupBy("image", "gh", "gw").agg(F.count(F.lit(1)).alias("n"))
    many = full.where(F.col("n") > AGAIN * F.col("gh") * F.col("gw")).select("image")
    inside = eroded(once.join(many, "image", "left_semi"), True).unionByName(once.join(many, "image", "left_anti"))
    box = inside.groupBy("image").agg(F.min("cy").alias("cy0"), F.min("cx").alias("cx0"), (F.max("cy") + 1).alias("cy1"), (F.max("cx") + 1).alias("cx1"))
    j = sizes(pixels).join(box, "image", "left").withColumn("gh", F.floor(F.col("h") / band)).withColumn("gw", F.floor(F.col("w") / band))
    low = lambda a, n, g: F.floor(F.col(a) * F.col(n) / F.col(g)) + margin
    high = lambda a, n, g: F.least(F.col(n), F.floor(F.col(a) * F.col(n) / F.col(g)) - margin)
    j = j.select("image", "h", "w", ((F.col("gh") < 3) | (F.col("gw") < 3)).alias("tiny"), low("cy0", "h", "gh").alias("y0"), low("cx0", "w", "gw").alias("x0"), high("cy1", "h", "gh").alias("y1"), high("cx1", "w", "gw").alias("x1"))
    sound = F.col("y0").isNotNull() & (F.col("y1") > F.col("y0") + 8) & (F.col("x1") > F.col("x0") + 8)
    pick = lambda tiny, box, all_, name: F.when(F.col("tiny"), tiny).when(sound, box).otherwise(all_).cast("long").alias(name)
    return j.select(
        "image", pick(F.lit(margin), F.col("y0"), F.lit(0), "y0"), pick(F.lit(margin), F.col("x0"), F.lit(0), "x0"),
        pick(F.col("h") - margin, F.col("y1"), F.col("h"), "y1"), pick(F.col("w") - margin, F.col("x1"), F.col("w"), "x1"),
    )


def trim_cast(pixels: DataFrame, boxes: DataFrame, *, step: int = 3, least: int = 32, guard: int = 64) -> DataFrame:
    """(image, y0, x0, y1, x1): boxes without their tinted borders. Against the box's core, a strip is cast if its colour ratios
    lie off the core's, and starts a trim if they lie far off and it is saturated; the trim goes on over strips that are
    cast, and stops at the guard depth (a tenth of the box at most). Left and right go first, top and bottom within what they
    leave. Boxes of at most twice ``least`` a side stay as they are."""
    eps = 1e-6
    rows = pixels.join(boxes, "image").where(F.col("y").between(F.col("y0"), F.col("y1") - 1) & F.col("x").between(F.col("x0"), F.col("x1") - 1))
    fits = (F.col("y1") - F.col("y0") > 2 * least) & (F.col("x1") - F.col("x0") > 2 * least)
    depth = F.least(F.lit(guard), F.greatest(F.lit(8), F.floor((F.col("x1") - F.col("x0")) / 10)), F.greatest(F.lit(8), F.floor((F.col("y1") - F.col("y0")) / 10)))
    ratio = lambda c: F.ln((F.col(c) + eps) / (F.col("g") + eps))
    rows = rows.where(fits).select("image", "y", "x", "y0", "x0", "y1", "x1", depth.alias("depth"), ratio("r").alias("rg"), ratio("b").alias("bg"), (F.greatest("r", "g", "b") - F.least("r", "g", "b")).alias("sat"))
    rows = materialize(rows, "ratios")
    core = rows.where((F.col("y") >= F.col("y0") + least) & (F.col("y") < F.col("y1") - least) & (F.col("x") >= F.col("x0") + least) & (F.col("x") < F.col("x1") - least))
    planes = ("rg", "bg", "sat")
    med = core.groupBy("image").agg(*[F.median(c).alias("m_" + c) for c in planes])
    mad = core.join(med, "image").groupBy("image").agg(*[F.first("m_" + c).alias("m_" + c) for c in planes], *[(F.median(F.abs(F.col(c) - F.col("m_" + c))) + eps).alias("d_" + c) for c in planes])
    told = materialize(mad.select("image", "m_rg", "m_bg", *[F.greatest(F.lit(CAST), MADS * F.col("d_" + c)).alias("t_" + c) for c in ("rg", "bg")], F.greatest(F.lit(SATURATION), F.col("m_sat") + 4 * F.col("d_sat")).alias("t_sat")), "core")

    def trimmed(rows: DataFrame, sides: dict) -> DataFrame:
        """(image, side, cut): pixels to take off each side; ``sides`` has the distance from each."""
        s = rows.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("side"), d.alias("far")) for n, d in sides.items()])).alias("e"))
        s = s.select("image", "depth", "rg", "bg", "sat", "e.side", F.floor(F.col("e.far") / step).alias("strip"), "e.far").where(F.col("strip") * step < F.col("depth"))
        m = s.groupBy("image", "side", "strip", "depth").agg(*[F.median(c).alias(c) for c in planes]).join(told, "image")
        off = lambda c: F.abs(F.col(c) - F.col("m_" + c))
        cast = (off("rg") > F.col("t_rg")) | (off("bg") > F.col("t_bg"))
        start = (F.col("strip") == 0) & (F.col("sat") >= F.col("t_sat")) & ((off("rg") > START * F.col("t_rg")) | (off("bg") > START * F.col("t_bg")))
        ends = m.groupBy("image", "side").agg(F.bool_or(start).alias("starts"), F.min(F.when(~cast, F.col("strip"))).alias("stop"), (F.max("strip") + 1).alias("most"))
        return ends.where("starts").select("image", "side", (F.coalesce("stop", "most") * step).alias("cut"))

    def applied(boxes: DataFrame, cuts: DataFrame, names: tuple[str, str]) -> DataFrame:
        c = cuts.groupBy("image").agg(*[F.max(F.when(F.col("side") == n, F.col("cut"))).alias("cut_" + n) for n in names])
        c = boxes.join(c, "image", "left")
        move = {n: (F.col(n) + (1 if n.endswith("0") else -1) * F.coalesce("cut_" + n, F.lit(0))).cast("long") for n in names}
        return c.select("image", *[(move[n] if n in move else F.col(n)).alias(n) for n in ("y0", "x0", "y1", "x1")])

    across = materialize(trimmed(rows, {"x0": F.col("x") - F.col("x0"), "x1": F.col("x1") - 1 - F.col("x")}), "cuts")
    held = materialize(applied(boxes, across, ("x0", "x1")), "boxes")
    left = rows.drop("x0", "x1").join(held.select("image", "x0", "x1"), "image").where(F.col("x").between(F.col("x0"), F.col("x1") - 1))
    down = trimmed(left, {"y0": F.col("y") - F.col("y0"), "y1": F.col("y1") - 1 - F.col("y")})
    return applied(held, down, ("y0", "y1"))


def feather(coverage: DataFrame, *, least: float = 3.0, share: float = 0.4, margin_percent: float = 5.0, decay: float = 1.0) -> DataFrame:
    """(image, y, x, alpha) of coverage maps (image, y, x, cover): 0 where coverage is under the threshold (``least``, and ``share`` of
    the image's most; if nothing passes, a quarter of the most, then anything), 1 from ``margin_percent`` of the shorter side
    inside on, and between them a power of the distance to the nearest place without. Places that no row tells have none.

    Distances are exact, in two passes: along columns by running places of the nearest, along rows, a row at a time, by the
    least of what columns within the margin give."""
    ship(coverage.sparkSession)
    size = coverage.groupBy("image").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.max("cover").alias("most"))
    need = F.greatest(F.lit(float(least)), share * F.col("most"))
    lower = F.greatest(0.25 * F.col("most"), F.lit(1.0))
    size = size.select("image", "h", "w", F.when(F.col("most") >= need, need).when((F.col("most") > 0) & (F.col("most") >= lower), lower).otherwise(0.0).alias("need"), F.when(F.lit(margin_percent) <= 0, 0.0).otherwise(F.greatest(F.lit(1.0), margin_percent * 0.01 * F.least("h", "w"))).alias("margin"))
    grid = size.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1)))
    j = grid.join(coverage.select("image", "y", "x", "cover"), ["image", "y", "x"], "left")
    good = F.when(F.col("need") > 0, F.col("cover") >= F.col("need")).otherwise(F.col("cover") > 0)
    j = j.select("image", "y", "x", "margin", F.coalesce(good, F.lit(False)).alias("good"))
    along = Window.partitionBy("image", "x").orderBy("y")
    bad = F.when(~F.col("good"), F.col("y"))
    up = F.last(bad, True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    down = F.first(bad, True).over(along.rowsBetween(0, Window.unboundedFollowing))
    j = j.withColumn("far", F.least(F.col("y") - up, down - F.col("y")).cast("double"))

    def across(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("x")
        x, far, ok = t.column("x").to_numpy(), t.column("far").to_numpy(zero_copy_only=False), t.column("good").to_numpy(zero_copy_only=False)
        margin = t.column("margin")[0].as_py()
        square = np.where(np.isfinite(far), far, np.inf) ** 2
        best = square.copy()
        for k in range(1, min(len(x), int(np.ceil(margin)) + 1)):
            best[k:] = np.minimum(best[k:], square[:-k] + k * k)
            best[:-k] = np.minimum(best[:-k], square[k:] + k * k)
        near = np.sqrt(best)
        alpha = np.where(near >= margin, 1.0, np.clip(near / margin, 0, 1) ** (1 / max(decay, 1e-3))) if margin > 0 else np.ones(len(x))
        return pa.table({"image": pa.array([key[0].as_py()] * len(x), key[0].type), "y": t.column("y"), "x": t.column("x"), "alpha": pa.array(np.where(ok, alpha, 0.0))})

    kind = coverage.schema["image"].dataType.simpleString()
    return j.groupBy("image", "y").applyInArrow(across, f"image {kind}, y long, x long, alpha double")
