"""Queries of the calibration of tiles: boxes are suppliers', samples their prices at cells of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import calibration as C
from lumenfold.operators import graph as G
from lumenfold.plans.base import STACK_SQL, registry, rounded, stack
from lumenfold.plans.normalize import _regression_sql
from lumenfold.plans.spatial import CELL, PAIRS_SQL, boxes, pairs
from lumenfold.session import materialize

QUERIES, SQL, query = registry()
#: Parts of one place, and how far a tile's own prices go from the mean of all at it.
PARTS, SPREAD = 16, 0.005


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


def true_gain(k: str = "id") -> F.Column:
    return 1 + F.col(k) % 9 / 100.0


def true_offset(k: str = "id") -> F.Column:
    return F.col(k) % 7 * 3.0


def samples(spark, d):
    """(id, place, value, stretch): what a tile shows at a place, seen through a gain and an offset of its own. Lines are sent once,
    by tile and stretch of places."""
    lines = stack(spark, d, "frame").select(F.col("frame").alias("id"), F.floor(F.col("pixel") / PARTS).alias("place"), F.col("value").alias("v"))
    every = materialize(lines.groupBy("place").agg((F.sum("v") / F.count("v")).alias("every")), "places")
    own = lines.withColumn("stretch", C.stretch()).repartition("id", "stretch").groupBy("id", "stretch", "place").agg(F.avg("v").alias("own"))
    value = (F.col("every") + (F.col("own") - F.col("every")) * SPREAD) * true_gain() + true_offset()
    return own.join(G.told(every), "place").select("id", "place", value.alias("value"), "stretch")


SAMPLES_SQL = (
    f"{STACK_SQL}, own AS (SELECT frame AS id, pixel // {PARTS} AS place, avg(value) AS own, sum(value) AS s, count(*) AS n FROM s GROUP BY ALL), every AS (SELECT place, sum(s) / sum(n) AS every FROM own GROUP BY place),"
    f" samples AS (SELECT id, place, (every + (own - every) * {SPREAD}) * (1 + (id % 9) / 100.0) + (id % 7) * 3.0 AS value FROM own JOIN every USING (place))"
)
LEAST = 0.7  # of a box's area: few enough edges for a whole calibration


@query(_with(PAIRS_SQL, "r AS (SELECT unnest([1.5, 1.1, 0.9, 0.5]) AS threshold)") + " SELECT threshold::DOUBLE AS threshold, count(*) AS pairs FROM r JOIN pairs ON fraction >= threshold GROUP BY threshold ORDER BY threshold DESC LIMIT 1")
def calibration_ladder(spark, d):
    """The first threshold, from the top, that leaves pairs, from one pass over them; no overlap reaches the top rung."""
    return C.ladder(pairs(spark, d), 1.5, (1.1, 0.9, 0.5)).where("threshold is not null")


FITS_SQL = _regression_sql(2.5, 6, 16, 8)
FITS_SQL = FITS_SQL[FITS_SQL.index("k0 AS (") :]
EDGES_SQL = f"e AS (SELECT i, j, area AS w FROM pairs WHERE fraction >= {LEAST})"
SKY_SQL = (
    "ps AS (SELECT e.i, e.j, a.value AS x, b.value AS y, (a.value + b.value) / 2 AS mid FROM e JOIN samples a ON a.id = e.i JOIN samples b ON b.id = e.j AND b.place = a.place)",
    f"cut AS (SELECT i, j, quantile_cont(mid, 0.3) AS lo, quantile_cont(mid, 0.7) AS hi FROM ps GROUP BY i, j HAVING count(*) >= {C.LEAST_SAMPLES})",
    "band AS (SELECT ps.*, hi <= lo OR mid BETWEEN lo AND hi AS inside, count(*) FILTER (hi <= lo OR mid BETWEEN lo AND hi) OVER (PARTITION BY i, j) AS m FROM ps JOIN cut USING (i, j))",
    f"p AS (SELECT i || '-' || j AS frame, x, y FROM band WHERE inside OR m < {C.LEAST_SKY})",
)
_HEAD, _, _TAIL = FITS_SQL.rpartition(" SELECT frame, round(any_value(CASE")
PAIR_FITS_SQL = (
    PAIRS_SQL + ", " + EDGES_SQL + ", " + SAMPLES_SQL + ", " + ", ".join(SKY_SQL) + ", " + _HEAD
    + ", fits AS (SELECT CAST(split_part(frame, '-', 1) AS BIGINT) AS i, CAST(split_part(frame, '-', 2) AS BIGINT) AS j, any_value(CASE WHEN total < 16 THEN 1 ELSE coalesce(slope, 1) END) AS a, any_value(CASE WHEN total < 16 THEN 0 ELSE coalesce(my - slope * mx, 0) END) AS b, any_value(n) AS n FROM f6 GROUP BY frame)"
)


def _fits(spark, d, least=LEAST):
    return C.fit_overlaps(boxes(spark, d), samples(spark, d), CELL, least)


@query("WITH " + PAIR_FITS_SQL.replace(EDGES_SQL, "e AS (SELECT i, j, area AS w FROM pairs)") + " SELECT i, j, round(a, 5) AS a, round(b, 4) AS b, n FROM fits")
def calibration_pairs(spark, d):
    """Each overlapping pair's relation y_j = a * y_i + b, fitted on the sky that both show, however little they overlap."""
    f = _fits(spark, d, 0.0)
    return f.select("i", "j", F.round("a", 5).alias("a"), F.round("b", 4).alias("b"), "n")


@query(
    "WITH " + PAIR_FITS_SQL + ", q AS (SELECT *, isfinite(a) AND isfinite(b) AS fine FROM fits), lim AS (SELECT count(*) FILTER (fine AND a BETWEEN 0.5 AND 0.6 AND abs(b) <= 5000) AS strict, quantile_disc(a, 0.01) FILTER (fine) AS lo, quantile_disc(a, 0.99) FILTER (fine) AS hi, quantile_disc(abs(a), 0.01) FILTER (fine) AS least FROM q)"
    " SELECT CASE WHEN NOT fine THEN 'non-finite' WHEN a < CASE WHEN strict = 0 THEN least(0.5, lo) ELSE 0.5 END OR a > CASE WHEN strict = 0 THEN greatest(0.6, hi) ELSE 0.6 END OR (strict = 0 AND abs(a) < greatest(1e-4, lim.least * 0.25)) THEN 'gain' WHEN abs(b) > 5000 THEN 'offset' ELSE 'kept' END AS reason, count(*) AS n FROM q, lim GROUP BY 1"
)
def calibration_constraints(spark, d):
    """Limits that no pair meets are widened to percentiles of all pairs; some are rejected even so."""
    f = C.constrain(materialize(_fits(spark, d), "pair-fits"), (0.5, 0.6))
    return f.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _relax_sql(rounds: int = 8) -> str:
    parts = [PAIR_FITS_SQL, "tt AS (SELECT j AS node, i AS other, n::DOUBLE AS w, 1.0 / a AS sc, -b / a AS u FROM fits UNION ALL SELECT i, j, n::DOUBLE, a, b FROM fits)", "ref AS (SELECT node FROM tt GROUP BY node ORDER BY count(*) DESC, node LIMIT 1)", "g0 AS (SELECT id, 1.0::DOUBLE AS gain, 0.0::DOUBLE AS o FROM boxes)"]
    for k in range(rounds):
        parts.append(f"w{k} AS (SELECT node AS id, sum(w * g.gain * sc) / sum(w) AS wg, sum(w * (g.o + g.gain * u)) / sum(w) AS wo FROM tt JOIN g{k} g ON g.id = other GROUP BY node)")
        fixed = "wg IS NULL OR id = (SELECT node FROM ref)"
        parts.append(f"g{k + 1} AS (SELECT id, CASE WHEN {fixed} THEN gain ELSE least(greatest(0.6 * gain + 0.4 * wg, 0.01), 100) END AS gain, CASE WHEN {fixed} THEN o ELSE 0.6 * o + 0.4 * wo END AS o FROM g{k} LEFT JOIN w{k} USING (id))")
    medians = "SELECT s_suppkey AS id, round(coalesce(CASE WHEN med <> 0 THEN (SELECT median(med) FROM mm WHERE med > 0) / med END, 1), 5) AS gain, 0.0::DOUBLE AS \"offset\", 'global-median' AS status FROM supplier LEFT JOIN mm ON mm.id = s_suppkey"
    parts.append("mm AS (SELECT id, median(value) AS med FROM samples GROUP BY id)")
    solved = f"SELECT id, round(gain, 5) AS gain, round(o, 4) + 0.0 AS \"offset\", 'solved-relaxation' AS status FROM g{rounds}"
    return "WITH " + ", ".join(parts) + f" {solved} WHERE EXISTS (SELECT 1 FROM e) UNION ALL {medians} WHERE NOT EXISTS (SELECT 1 FROM e)"


def _solution(c):
    return c.solution.select("id", F.round("gain", 5).alias("gain"), (F.round("offset", 4) + 0.0).alias("offset"), F.lit(c.status).alias("status"))


@query(_relax_sql())
def calibration_relaxed(spark, d):
    """The whole calibration with the relaxation alone."""
    return _solution(C.calibrate(boxes(spark, d), samples(spark, d), cell=CELL, min_overlap=LEAST, steps=(), neighbours=0, solvers=("relaxation",)))


@query("WITH " + SAMPLES_SQL + ", m AS (SELECT id, median(value) AS med FROM samples GROUP BY id) SELECT s_suppkey AS id, round(coalesce(CASE WHEN med <> 0 THEN (SELECT median(med) FROM m WHERE med > 0) / med END, 1), 5) AS gain, 0.0::DOUBLE AS \"offset\", 'global-median' AS status FROM supplier LEFT JOIN m ON m.id = s_suppkey")
def calibration_medians(spark, d):
    """No rung of the ladder leaves a pair: medians do."""
    return _solution(C.calibrate(boxes(spark, d), samples(spark, d), cell=CELL, min_overlap=1.5, steps=(1.2,)))


@query(None)
def intertile_calibration(spark, d):
    """From boxes to gains and offsets: threshold, pruning, fits, anchor, robust solution."""
    return _solution(C.calibrate(boxes(spark, d), samples(spark, d), cell=CELL, min_overlap=1.5, steps=(LEAST,)))


@query(
    "WITH " + PAIR_FITS_SQL + ", u AS (SELECT i AS id, e.w FROM fits JOIN e USING (i, j) UNION ALL SELECT j, e.w FROM fits JOIN e USING (i, j)), c AS (SELECT id, sum(w) AS c FROM u GROUP BY id), wt AS (SELECT s_suppkey AS id, 1.0 + s_suppkey % 5 AS weight FROM supplier), md AS (SELECT quantile_disc(weight, 0.5) AS m FROM wt)"
    " SELECT id AS anchor, round(coalesce(c, 0) * sqrt(weight / m), 4) AS score FROM wt LEFT JOIN c USING (id), md ORDER BY CASE WHEN (SELECT max(c) FROM c) > 0 THEN coalesce(c, 0) ELSE 1 END * sqrt(weight / m) DESC, id LIMIT 1"
)
def calibration_anchor(spark, d):
    """The tile that stays as it is: connected best, weighted by the root of its own weight."""
    f = materialize(_fits(spark, d), "pair-fits")
    w = boxes(spark, d).select("id", (1.0 + F.col("id") % 5).alias("weight"))
    a = C.anchor(f, boxes(spark, d), w)
    middle = w.agg(F.percentile_approx("weight", 0.5, 100000).alias("m"))
    own = G.endpoints(f, "w").where(F.col("node") == a).agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("c"))
    return own.crossJoin(middle).crossJoin(w.where(F.col("id") == a)).select(F.col("id").alias("anchor"), F.round(F.col("c") * F.sqrt(F.col("weight") / F.col("m")), 4).alias("score"))
