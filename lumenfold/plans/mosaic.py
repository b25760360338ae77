"""Queries of blending and assembly: a tile for each supplier, on a canvas ten tiles wide, its pixels from its prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import mosaic as M
from lumenfold.plans.base import registry, rounded
from lumenfold.session import table

QUERIES, SQL, query = registry()
SIDE, STEP, ACROSS = 24, 16, 10
CELL = 24.0


def tiles(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("tile"), (F.floor(k / ACROSS) * STEP).alias("y0"), (k % ACROSS * STEP).alias("x0"), F.lit(SIDE).cast("long").alias("h"), F.lit(SIDE).cast("long").alias("w"))


def pixels(spark, d):
    """(tile, y, x, value) on the canvas; where a supplier has no line the tile shows nothing."""
    t = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("tile"), (F.col("l_partkey") % SIDE).alias("py"), (F.floor(F.col("l_orderkey") / 7) % SIDE).alias("px")).agg(F.avg("l_extendedprice").alias("value"))
    return t.select("tile", (F.floor(F.col("tile") / ACROSS) * STEP + F.col("py")).alias("y"), (F.col("tile") % ACROSS * STEP + F.col("px")).alias("x"), F.sqrt("value").alias("value"))


def _patches(spark, d):
    return M.patches(pixels(spark, d), M.overlaps(tiles(spark, d), CELL))


TILES_SQL = f"tiles AS (SELECT s_suppkey AS tile, s_suppkey // {ACROSS} * {STEP} AS y0, s_suppkey % {ACROSS} * {STEP} AS x0 FROM supplier)"
PIXELS_SQL = f"px AS (SELECT l_suppkey AS tile, l_suppkey // {ACROSS} * {STEP} + l_partkey % {SIDE} AS y, l_suppkey % {ACROSS} * {STEP} + l_orderkey // 7 % {SIDE} AS x, sqrt(avg(l_extendedprice)) AS value FROM lineitem GROUP BY ALL)"
REGIONS_SQL = f"r AS (SELECT a.tile AS i, b.tile AS j, greatest(a.y0, b.y0) AS y0, greatest(a.x0, b.x0) AS x0, least(a.y0, b.y0) + {SIDE} - greatest(a.y0, b.y0) AS h, least(a.x0, b.x0) + {SIDE} - greatest(a.x0, b.x0) AS w FROM tiles a JOIN tiles b ON a.tile < b.tile AND abs(a.y0 - b.y0) < {SIDE} AND abs(a.x0 - b.x0) < {SIDE})"
GRID_SQL = (
    "g AS (SELECT r.*, ty.y, tx.x, a.value AS va, b.value AS vb, CASE WHEN w >= h THEN tx.x / greatest(w - 1, 1)::DOUBLE ELSE ty.y / greatest(h - 1, 1)::DOUBLE END AS ramp FROM r, unnest(range(h)) ty(y), unnest(range(w)) tx(x)"
    " LEFT JOIN px a ON a.tile = r.i AND a.y = r.y0 + ty.y AND a.x = r.x0 + tx.x LEFT JOIN px b ON b.tile = r.j AND b.y = r.y0 + ty.y AND b.x = r.x0 + tx.x)"
)
SHARES_SQL = (
    "q AS (SELECT *, CASE WHEN va IS NULL THEN 0 ELSE 1 - ramp END AS ra, CASE WHEN vb IS NULL THEN 0 ELSE ramp END AS rb FROM g)",
    "g0 AS (SELECT i, j, h, w, y, x, va, vb, coalesce(va, 0) AS a, coalesce(vb, 0) AS b, CASE WHEN ra + rb > 0 THEN ra / greatest(ra + rb, 1e-6) ELSE 0 END AS wa, CASE WHEN ra + rb > 0 THEN rb / greatest(ra + rb, 1e-6) ELSE 0 END AS wb FROM q)",
)
BASE_SQL = ", ".join((TILES_SQL, PIXELS_SQL, REGIONS_SQL, GRID_SQL, *SHARES_SQL))


def _pyramid_sql() -> str:
    """blend AS (i, j, y, x, value, weight), from levels g0 (finest) to g3."""
    parts = []
    for k in range(1, M.LEVELS):
        parts.append(
            f"g{k} AS (SELECT c.i, c.j, c.h, c.w, c.y, c.x, sum(p.a) / 9 AS a, sum(p.b) / 9 AS b, sum(p.wa) / 9 AS wa, sum(p.wb) / 9 AS wb FROM (SELECT i, j, (h + 1) // 2 AS h, (w + 1) // 2 AS w, h AS ph, w AS pw, y // 2 AS y, x // 2 AS x FROM g{k - 1} WHERE y % 2 = 0 AND x % 2 = 0) c,"
            f" unnest([-1, 0, 1]) dy(dy), unnest([-1, 0, 1]) dx(dx) JOIN g{k - 1} p ON p.i = c.i AND p.j = c.j AND p.y = least(greatest(2 * c.y + dy, 0), ph - 1) AND p.x = least(greatest(2 * c.x + dx, 0), pw - 1) GROUP BY ALL)"
        )
    top = M.LEVELS - 1
    parts.append(f"o{top} AS (SELECT i, j, y, x, (a * wa + b * wb) / greatest(wa + wb, 1e-6) AS v FROM g{top})")
    for k in reversed(range(top)):
        parts.append(f"o{k} AS (SELECT f.i, f.j, f.y, f.x, o.v + ((f.a - c.a) * f.wa + (f.b - c.b) * f.wb) / greatest(f.wa + f.wb, 1e-6) AS v FROM g{k} f JOIN g{k + 1} c ON c.i = f.i AND c.j = f.j AND c.y = f.y // 2 AND c.x = f.x // 2 JOIN o{k + 1} o ON o.i = f.i AND o.j = f.j AND o.y = f.y // 2 AND o.x = f.x // 2)")
    parts.append(f"blend AS (SELECT f.i, f.j, f.y, f.x, CASE WHEN least(h, w) >= {M.LEAST_SIDE} THEN o.v ELSE (a * wa + b * wb) / greatest(wa + wb, 1e-6) END AS value, wa + wb AS weight FROM g0 f JOIN o0 o USING (i, j, y, x) WHERE va IS NOT NULL OR vb IS NOT NULL)")
    return ", ".join(parts)


PYRAMID_SQL = _pyramid_sql()


@query(f"WITH {BASE_SQL} SELECT i, j, y, x, round((a * wa + b * wb) / greatest(wa + wb, 1e-6), 6) AS value, round(wa + wb, 6) AS weight FROM g0 WHERE va IS NOT NULL OR vb IS NOT NULL")
def overlap_blend_ramp(spark, d):
    """Shared regions of neighbouring tiles, blended by ramps along the longer side."""
    return rounded(M.blend(_patches(spark, d), ["i", "j"], pyramid=False))


@query(f"WITH {BASE_SQL}, {PYRAMID_SQL} SELECT i, j, y, x, round(value, 6) AS value, round(weight, 6) AS weight FROM blend")
def overlap_blend_pyramid(spark, d):
    """The same by Laplacian pyramids of four levels, in blocks with their margins."""
    return rounded(M.blend(_patches(spark, d), ["i", "j"]))


@query(
    f"WITH {BASE_SQL}, {PYRAMID_SQL}, used AS (SELECT r.* FROM r JOIN (SELECT i, j FROM blend GROUP BY i, j HAVING max(weight) > 0) USING (i, j)), alone AS (SELECT y, x, value, 1.0 AS weight FROM px WHERE NOT EXISTS (SELECT 1 FROM used u WHERE px.tile IN (u.i, u.j) AND px.y >= u.y0 AND px.y < u.y0 + u.h AND px.x >= u.x0 AND px.x < u.x0 + u.w)),"
    " every AS (SELECT blend.y + y0 AS y, blend.x + x0 AS x, value, weight FROM blend JOIN r USING (i, j) UNION ALL SELECT * FROM alone) SELECT y, x, round(sum(value * weight) / sum(weight), 6) AS value, round(sum(weight), 6) AS weight FROM every GROUP BY y, x HAVING sum(weight) > 0"
)
def mosaic_assembly(spark, d):
    """The canvas: blended regions weighed together, and what only one tile shows."""
    return rounded(M.assemble(tiles(spark, d), pixels(spark, d), cell=CELL))
