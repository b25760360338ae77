"""Queries on points, boxes and polygons."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.functions import columns as C
from lumenfold.operators import spatial as S
from lumenfold.operators.selection import quantiles
from lumenfold.plans.base import registry, rounded
from lumenfold.session import table

QUERIES, SQL, query = registry()

ITEMS_SQL = "items AS (SELECT vec_id AS id, label, 180 + 170 * e1 / (1 + abs(e1)) AS ra, 80 * e2 / (1 + abs(e2)) AS \"dec\", degrees(atan2(e4, e3)) AS angle FROM (SELECT vec_id, label, embedding[1]::DOUBLE AS e1, embedding[2]::DOUBLE AS e2, embedding[3]::DOUBLE AS e3, embedding[4]::DOUBLE AS e4 FROM embeddings))"
BOXES_SQL = "boxes AS (SELECT s_suppkey AS id, (s_acctbal + 1000) / 11 - 60 AS x0, (s_acctbal + 1000) / 11 + 60 AS x1, s_nationkey * 40.0 - 45 - s_suppkey % 7 AS y0, s_nationkey * 40.0 + 45 + s_suppkey % 5 AS y1, s_nationkey % 3 AS mode, s_acctbal FROM supplier)"
PAIRS_SQL = BOXES_SQL + """, pairs AS (SELECT i, j, area, area / ai AS frac_i, area / aj AS frac_j, least(area / ai, area / aj) AS strength, greatest(area / ai, area / aj) AS fraction FROM
 (SELECT a.id AS i, b.id AS j, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS area, (a.x1 - a.x0) * (a.y1 - a.y0) AS ai, (b.x1 - b.x0) * (b.y1 - b.y0) AS aj
  FROM boxes a JOIN boxes b ON a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1))"""
CELL = 120.0


def items(spark, d):
    """items(id, label, ra, dec, angle) from the first numbers of each vector."""
    e = lambda i: F.try_element_at("embedding", F.lit(i)).cast("double")

    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", (180 + 170 * e(1) / (1 + F.abs(e(1)))).alias("ra"), (80 * e(2) / (1 + F.abs(e(2)))).alias("dec"), F.degrees(F.atan2(e(4), e(3))).alias("angle"))


def boxes(spark, d):
    """Boxes of suppliers; mode is their mount's."""
    x, y, k = (F.col("s_acctbal") + 1000) / 11, F.col("s_nationkey") * 40.0, F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), (x - 60).alias("x0"), (x + 60).alias("x1"), (y - 45 - k % 7).alias("y0"), (y + 45 + k % 5).alias("y1"), (F.col("s_nationkey") % 3).alias("mode"), "s_acctbal")


def pairs(spark, d, least=0.0):
    return S.overlap_pairs(boxes(spark, d), CELL, least)


def _with(*parts):
    return "WITH " + ", ".join(parts)


@query(_with(PAIRS_SQL) + " SELECT i, j, round(area, 6) AS area, round(frac_i, 6) AS frac_i, round(frac_j, 6) AS frac_j, round(strength, 6) AS strength, round(fraction, 6) AS fraction FROM pairs")
def overlap_pairs(spark, d):
    return S.told_apart(rounded(S.equal_pairs(boxes(spark, d), CELL).drop("dx", "dy")))


@query(_with(PAIRS_SQL) + " SELECT i, j, round(fraction, 6) AS fraction FROM pairs WHERE fraction >= 0.25")
def overlap_fraction_filter(spark, d):
    return rounded(pairs(spark, d, 0.25).select("i", "j", "fraction"))


GRID_SQL = BOXES_SQL + """, bounds AS (SELECT min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM boxes), n AS (SELECT *, greatest(ceil((x1 - x0) / 96), 1)::BIGINT AS nx, greatest(ceil((y1 - y0) / 96), 1)::BIGINT AS ny FROM bounds),
 tiles AS (SELECT t + 1 AS tile_id, x0 + (t % nx) * 96.0 AS tx0, least(x0 + (t % nx) * 96.0 + 120, x1) AS tx1, y0 + (t // nx) * 96.0 AS ty0, least(y0 + (t // nx) * 96.0 + 120, y1) AS ty1 FROM (SELECT *, unnest(range(nx * ny)) AS t FROM n))"""


def _grid(spark, d):
    b = boxes(spark, d).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    return S.uniform_grid(b, 120.0, 0.2)


@query(_with(GRID_SQL) + " SELECT tile_id, round(tx0, 6) AS tx0, round(tx1, 6) AS tx1, round(ty0, 6) AS ty0, round(ty1, 6) AS ty1 FROM tiles")
def uniform_grid(spark, d):
    return rounded(_grid(spark, d))


@query(_with(GRID_SQL) + " SELECT tile_id, id AS frame FROM tiles JOIN boxes ON x0 <= tx1 AND tx0 <= x1 AND y0 <= ty1 AND ty0 <= y1")
def assign_frames_to_tiles(spark, d):
    f = boxes(spark, d).select(F.col("id").alias("frame"), *[F.col(c).alias("a_" + c) for c in ("x0", "x1", "y0", "y1")])
    t = _grid(spark, d).select("tile_id", *[F.col("t" + c).alias("b_" + c) for c in ("x0", "x1", "y0", "y1")])
    return S.box_join(f, t, CELL, inclusive=True).select("tile_id", "frame")


@query(_with(ITEMS_SQL) + " SELECT id, label FROM items WHERE (ra BETWEEN 150 AND 220 AND \"dec\" BETWEEN -20 AND 25) OR (ra + 2 >= 150 AND ra - 2 <= 220 AND \"dec\" + 1 >= -20 AND \"dec\" - 1 <= 25)")
def rect_select(spark, d):
    inside = F.col("ra").between(150, 220) & F.col("dec").between(-20, 25)
    touch = (F.col("ra") + 2 >= 150) & (F.col("ra") - 2 <= 220) & (F.col("dec") + 1 >= -20) & (F.col("dec") - 1 <= 25)
    return items(spark, d).where(inside | touch).select("id", "label")


@query(_with(ITEMS_SQL) + " SELECT DISTINCT i.label FROM items i WHERE ra BETWEEN 170 AND 190 AND \"dec\" BETWEEN -10 AND 10")
def groups_in_bounds(spark, d):
    i = items(spark, d)
    hit = i.where(F.col("ra").between(170, 190) & F.col("dec").between(-10, 10)).select("label")
    return i.select("label").distinct().join(hit, "label", "left_semi")


CENTRE = "(SELECT ((degrees(atan2(avg(cos(radians(\"dec\")) * sin(radians(ra))), avg(cos(radians(\"dec\")) * cos(radians(ra))))) % 360) + 360) % 360 AS cra, degrees(atan2(avg(sin(radians(\"dec\"))), sqrt(pow(avg(cos(radians(\"dec\")) * cos(radians(ra))), 2) + pow(avg(cos(radians(\"dec\")) * sin(radians(ra))), 2)))) AS cdec{by} FROM items{group})"


@query(_with(ITEMS_SQL, "c AS " + CENTRE.format(by="", group="")) + " SELECT id, round(sqrt(pow(least((ra - cra + 720) % 360, 360 - (ra - cra + 720) % 360), 2) + pow(\"dec\" - cdec, 2)), 6) AS distance FROM items, c WHERE sqrt(pow(least((ra - cra + 720) % 360, 360 - (ra - cra + 720) % 360), 2) + pow(\"dec\" - cdec, 2)) <= 40")
def distance_exclude(spark, d):
    i = items(spark, d)
    c = F.broadcast(S.centroid(i, []).select(F.col("ra").alias("cra"), F.col("dec").alias("cdec")))
    far = C.planar_distance(F.col("ra"), F.col("dec"), F.col("cra"), F.col("cdec"))
    return rounded(i.crossJoin(c).select("id", far.alias("distance")).where("distance IS NULL OR distance <= 40"))


@query(_with(ITEMS_SQL, "c AS " + CENTRE.format(by=", label, count(*) AS n", group=" GROUP BY label")) + " SELECT label, round(cra, 6) AS ra, round(cdec, 6) AS \"dec\", n FROM c")
def spherical_centroid(spark, d):
    return rounded(S.centroid(items(spark, d), ["label"]))


GREAT = "degrees(acos(greatest(-1, least(1, sin(radians(a.\"dec\")) * sin(radians(b.\"dec\")) + cos(radians(a.\"dec\")) * cos(radians(b.\"dec\")) * cos(radians(a.ra - b.ra))))))"


@query(_with(ITEMS_SQL, f"n AS (SELECT a.id, min({GREAT}) AS nn FROM items a JOIN items b ON a.id <> b.id GROUP BY a.id)") + " SELECT round(quantile_cont(nn, 0.9), 5) AS p90, round(1.1 * quantile_cont(nn, 0.9), 5) AS relaxed, count(*) AS n FROM n")
def great_circle_nn_p90(spark, d):
    n = S.nearest(items(spark, d))
    p = quantiles(n, [], F.col("nn_deg"), {"p90": 0.9})
    return p.crossJoin(n.agg(F.count(F.lit(1)).alias("n"))).select(F.round("p90", 5).alias("p90"), F.round(1.1 * F.col("p90"), 5).alias("relaxed"), "n")  # one row each


@query(_with(ITEMS_SQL, "c AS (SELECT label, avg(ra) AS x, avg(\"dec\") AS y FROM items GROUP BY label)", "p AS (SELECT a.label AS label, b.label AS near, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance FROM c a JOIN c b ON a.label <> b.label)") + " SELECT label, near, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, near) AS rank FROM p) WHERE rank <= 4")
def knn_groups(spark, d):
    c = items(spark, d).groupBy("label").agg(F.avg("ra").alias("x"), F.avg("dec").alias("y"))
    o = c.select(F.col("label").alias("near"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    p = c.join(o, F.col("label") != F.col("near"))  # groups, not items
    far = F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2)
    w = Window.partitionBy("label").orderBy("distance", "near")
    return p.select("label", "near", far.alias("distance")).withColumn("rank", F.row_number().over(w)).where("rank <= 4").select("label", "near", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(_with(BOXES_SQL) + " SELECT id, round(abs((x0 * y0 - x1 * y0) + (x1 * y1 - (x1 + 9) * y0) + ((x1 + 9) * y1 - x0 * y1) + (x0 * y0 - x0 * y1)) / 2, 6) AS area FROM (SELECT id, x0, x1, y0, y1 FROM boxes)")
def polygon_area(spark, d):
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    poly = F.array(pt(x0, y0), pt(x1, y0), pt(x1 + 9, y1), pt(x0, y1))
    return rounded(boxes(spark, d).select("id", C.polygon_area(poly).alias("area")))


@query(_with(ITEMS_SQL, "a AS (SELECT DISTINCT label, (ra % 360 + 360) % 360 AS a FROM items)", "g AS (SELECT label, a, coalesce(lead(a) OVER w, min(a) OVER (PARTITION BY label)) AS after, coalesce(lead(a) OVER w, min(a) OVER (PARTITION BY label) + 360) - a AS gap FROM a WINDOW w AS (PARTITION BY label ORDER BY a))") + " SELECT label, round(360 - max(gap), 6) AS span, round(arg_max(after, {'g': gap, 'a': -a}), 6) AS start FROM g GROUP BY label")
def ra_wrap_span(spark, d):
    g = S.largest_gap(items(spark, d), ["label"], "ra")
    return rounded(g.select("label", (F.lit(360.0) - F.col("gap")).alias("span"), "start"))


@query(_with(ITEMS_SQL, "a AS (SELECT DISTINCT label, (angle % 360 + 360) % 360 AS a FROM items WHERE angle IS NOT NULL)", "g AS (SELECT label, coalesce(lead(a) OVER w, min(a) OVER (PARTITION BY label) + 360) - a AS gap FROM a WINDOW w AS (PARTITION BY label ORDER BY a))") + " SELECT label, round(360 - max(gap), 6) AS dispersion FROM g GROUP BY label")
def circular_dispersion(spark, d):
    return rounded(S.largest_gap(items(spark, d), ["label"], "angle").select("label", (F.lit(360.0) - F.col("gap")).alias("dispersion")))


@query(_with(ITEMS_SQL, "m AS (SELECT label, degrees(atan2(sum(sin(radians(angle))), sum(cos(radians(angle))))) AS mean FROM items GROUP BY label)") + " SELECT label, round(max(least((angle - mean + 720) % 360, 360 - (angle - mean + 720) % 360)), 6) AS deviation FROM items JOIN m USING (label) GROUP BY label")
def circular_deviation(spark, d):
    i = items(spark, d)
    r = math.pi / 180
    m = i.groupBy("label").agg(F.degrees(F.atan2(F.sum(F.sin(F.col("angle") * r)), F.sum(F.cos(F.col("angle") * r)))).alias("mean"))
    return rounded(i.join(m, "label").groupBy("label").agg(F.max(C.circular_delta(F.col("angle"), F.col("mean"))).alias("deviation")))


@query(_with(ITEMS_SQL, "c AS (SELECT label, avg(ra) AS x, avg(\"dec\") AS y, count(*) AS n FROM items GROUP BY label)") + " SELECT label, round(any_value(x), 6) AS x, round(any_value(y), 6) AS y, round(max(sqrt(pow(ra - x, 2) + pow(\"dec\" - y, 2))), 6) AS radius, any_value(n) AS n FROM items JOIN c USING (label) GROUP BY label")
def center_and_radius(spark, d):
    i = items(spark, d)
    c = i.groupBy("label").agg(F.avg("ra").alias("x"), F.avg("dec").alias("y"), F.count(F.lit(1)).alias("n"))
    far = F.sqrt((F.col("ra") - F.col("x")) ** 2 + (F.col("dec") - F.col("y")) ** 2)
    return rounded(i.join(c, "label").groupBy("label").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.max(far).alias("radius"), F.first("n").alias("n")))


@query(_with(BOXES_SQL) + " SELECT count(*) AS n, round(max(x1) - min(x0), 6) AS span_x, round(max(y1) - min(y0), 6) AS span_y, greatest(8, ceil((max(x1) - min(x0)) * 1.02 / median(x1 - x0) * 16))::BIGINT AS width, greatest(8, ceil((max(y1) - min(y0)) * 1.02 / median(y1 - y0) * 16))::BIGINT AS height FROM boxes")
def global_grid_descriptor(spark, d):
    span = lambda a: F.max(a + "1") - F.min(a + "0")
    cells = lambda a: F.greatest(F.lit(8), F.ceil(span(a) * 1.02 / F.median(F.col(a + "1") - F.col(a + "0")) * 16)).cast("long")
    return rounded(boxes(spark, d).agg(F.count(F.lit(1)).alias("n"), span("x").alias("span_x"), span("y").alias("span_y"), cells("x").alias("width"), cells("y").alias("height")))


@query(None)
def polygon_overlap(spark, d):
    """Convex overlap areas of leaning quadrilaterals: boxes first, then exact clipping in Arrow batches."""
    import numpy as np
    import pandas as pd

    from lumenfold.operators.kernels import clip_areas
    from lumenfold.session import ship

    ship(spark)
    b = boxes(spark, d).withColumn("x1", F.col("x1") + 9)
    side = ["x0", "x1", "y0", "y1"]
    p = S.box_join(b.select(F.col("id").alias("i"), *[F.col(c).alias("a_" + c) for c in side]), b.select(F.col("id").alias("j"), *[F.col(c).alias("b_" + c) for c in side]), CELL, inclusive=False, extra=F.col("i") < F.col("j"))

    def area(frames):
        for f in frames:
            quad = lambda s: np.stack([np.stack([f[s + x] - d, f[s + y]], 1) for x, d, y in (("x0", 0, "y0"), ("x1", 9, "y0"), ("x1", 0, "y1"), ("x0", 0, "y1"))], 1)  # noqa: B023, E731
            yield pd.DataFrame({"i": f["i"], "j": f["j"], "area": clip_areas(quad("a_"), quad("b_"))})

    return p.mapInPandas(area, "i long, j long, area double").where("area > 0")
