"""Queries of whole pipelines and of the smaller operators between them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.functions import columns as C
from lumenfold.operators import graph as G
from lumenfold.operators import pipeline as P
from lumenfold.operators import spatial as S
from lumenfold.plans.base import STACK_SQL, registry, rounded, stack
from lumenfold.plans.combine import KEPT, _clipped
from lumenfold.plans.graph import EDGES_SQL, FITS_SQL, TOP_SQL, _relax_sql, edges, fits, relaxed
from lumenfold.plans.grouping import MODES_SQL, grouped
from lumenfold.plans.spatial import BOXES_SQL, CELL, ITEMS_SQL, PAIRS_SQL, boxes, items, pairs
from lumenfold.session import materialize, ship, table

QUERIES, SQL, query = registry()
K = ["pixel"]


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


_LINEAR = (
    "p AS (SELECT frame, quantile_cont(value, 0.25) AS low, quantile_cont(value, 0.9) AS high FROM s0 GROUP BY frame)",
    "r AS (SELECT low AS rl, high AS rh FROM p ORDER BY frame LIMIT 1)",
    "ab AS (SELECT frame, CASE WHEN abs(high - low) < greatest(1e-3, 1e-3 * greatest(abs(low), abs(high), 1.0)) THEN 1.0 WHEN abs(rh - rl) > 1e-5 THEN (rh - rl) / (high - low) ELSE 1.0 END AS a, low, rl FROM p, r)",
    "n AS (SELECT pixel, s0.frame, weight, a * value + (rl - a * low) AS value FROM s0 JOIN ab USING (frame))",
)


@query(
    _with(STACK_SQL.replace("s AS", "s0 AS", 1), *_LINEAR, _clipped("value", 5, "n", "zf").replace("PARTITION BY pixel", "PARTITION BY frame"), "vf AS (SELECT frame, any_value(sd) * any_value(sd) AS variance FROM zf GROUP BY frame)",
          "s AS (SELECT n.pixel, n.value, n.weight * coalesce((SELECT min(variance) FROM vf WHERE variance > 0) / CASE WHEN variance > 0 THEN variance END, 1e-6) AS weight FROM n JOIN vf USING (frame))",
          "z AS (SELECT *, median(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM s WINDOW w AS (PARTITION BY pixel))", "k AS (SELECT *, value >= m - 1.8 * sd AND value <= m + 1.8 * sd AS kept FROM z)") + KEPT
)
def stack_pipeline(spark, d):
    s = P.stack(stack(spark, d, "frame"), K, normalization="linear_fit", weighting="noise_variance", rejection="kappa", low=1.8, high=1.8)
    return rounded(s)


@query(
    _with(STACK_SQL, "m AS (SELECT frame, median(value) AS med FROM s GROUP BY frame)", "r AS (SELECT med AS ref FROM m ORDER BY frame LIMIT 1)", "n AS (SELECT pixel, value * CASE WHEN med <> 0 THEN ref / med ELSE 1 END AS value FROM s JOIN m USING (frame), r)", "z AS (SELECT *, median(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM n WINDOW w AS (PARTITION BY pixel))", "k AS (SELECT *, value >= m - 1.5 * sd AND value <= m + 1.5 * sd AS kept FROM z)")
    + " SELECT pixel, round(median(value) FILTER (kept), 6) AS value, count(*) FILTER (kept) AS kept, round(100.0 * (count(*) - count(*) FILTER (kept)) / count(*), 6) AS rejected_pct FROM k GROUP BY pixel"
)
def patch_stack_median(spark, d):
    return rounded(P.stack(stack(spark, d, "frame"), K, normalization="median_ratio", rejection="kappa", combine="median", low=1.5, high=1.5))


@query("WITH RECURSIVE " + ITEMS_SQL + ", e AS (SELECT a.id AS n, b.id AS o FROM items a JOIN items b ON a.id <> b.id AND sqrt(pow(a.ra - b.ra, 2) + pow(a.\"dec\" - b.\"dec\", 2)) <= 6), r(id, c) AS (SELECT id, id FROM items UNION SELECT e.n, r.c FROM r JOIN e ON e.o = r.id) SELECT id, min(c) AS cluster FROM r GROUP BY id")
def connected_clusters(spark, d):
    return _clusters(spark, d)


def _clusters(spark, d, within: float = 6.0):
    """Single linkage by planar distance."""
    i = items(spark, d).select("id", F.col("ra").alias("x"), F.col("dec").alias("y"))
    return S.near_components(i, within).select("id", F.col("component").alias("cluster"))


@query("WITH RECURSIVE " + MODES_SQL + ", e AS (SELECT a.id AS n, b.id AS o FROM items a JOIN items b ON a.id <> b.id AND sqrt(pow(a.ra - b.ra, 2) + pow(a.\"dec\" - b.\"dec\", 2)) <= 6), r(id, c) AS (SELECT id, id FROM items UNION SELECT e.n, r.c FROM r JOIN e ON e.o = r.id), m AS (SELECT id, min(c) AS cluster FROM r GROUP BY id) SELECT cluster, mode, count(*) AS n, ceil(count(*) / 40)::BIGINT AS batches FROM m JOIN g USING (id) GROUP BY ALL")
def auto_groups(spark, d):
    m = _clusters(spark, d).join(grouped(spark, d).select("id", "mode"), "id")
    return m.groupBy("cluster", "mode").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / 40).cast("long").alias("batches"))


@query("WITH RECURSIVE " + EDGES_SQL + ", " + TOP_SQL + ", b AS (SELECT i AS n, j AS o FROM kept UNION ALL SELECT j, i FROM kept), r(id, c) AS (SELECT id, id FROM boxes UNION SELECT b.n, r.c FROM r JOIN b ON b.o = r.id), m AS (SELECT id, min(c) AS c FROM r GROUP BY id) SELECT (SELECT count(*) FROM e) AS raw, (SELECT count(*) FROM kept) AS kept, (SELECT count(DISTINCT c) FROM m) AS components")
def prune_summary(spark, d):
    e = edges(spark, d)
    k = G.top_edges(e, 2)
    c = G.components(boxes(spark, d), k).agg(F.count_distinct("component").alias("components"))
    return e.agg(F.count(F.lit(1)).alias("raw")).crossJoin(k.agg(F.count(F.lit(1)).alias("kept"))).crossJoin(c)


@query(_with(PAIRS_SQL.replace("SELECT i, j, area, area / ai", "SELECT i, j, dx, dy, area, area / ai").replace("SELECT a.id AS i, b.id AS j,", "SELECT a.id AS i, b.id AS j, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS dx, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS dy,")) + " SELECT i, j, CASE WHEN dx >= dy THEN 'x' ELSE 'y' END AS axis, t AS step, round(t / 4.0, 6) AS weight_j, round(1 - t / 4.0, 6) AS weight_i FROM pairs, (SELECT unnest(range(5)) AS t)")
def overlap_blend_weights(spark, d):
    """Ramps along the longer side of an overlap; the two weights add to one."""
    p = S.equal_pairs(boxes(spark, d), CELL).select("a_ids", "b_ids", "same", F.when(F.col("dx") >= F.col("dy"), "x").otherwise("y").alias("axis"))
    steps = F.array(*[F.struct(F.lit(k).cast("long").alias("step"), F.lit(k / 4).alias("weight_j"), F.lit(1 - k / 4).alias("weight_i")) for k in range(5)])
    return S.told_apart(p).select("i", "j", "axis", F.inline(steps))


@query(f"WITH g AS ({_relax_sql()}), {STACK_SQL} SELECT pixel, round(sum((value * gain + g.\"offset\") * weight) / greatest(sum(weight), 1e-6), 4) AS value, count(*) AS n FROM s JOIN g ON s.frame = g.id GROUP BY pixel")
def assemble_tiles(spark, d):
    """Each tile's samples scaled by the relaxed gains and offsets, then averaged where tiles overlap. Gains are told to the samples,
    which so stay where they are until they are summed up."""
    g = relaxed(spark, d).select(F.col("id").alias("frame"), F.round("gain", 6).alias("gain"), (F.round("offset", 6) + 0.0).alias("o"))
    s = stack(spark, d, "frame").join(G.told(materialize(g, "gains")), "frame")
    return s.groupBy("pixel").agg(F.round(F.sum((F.col("value") * F.col("gain") + F.col("o")) * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(1e-6)), 4).alias("value"), F.count(F.lit(1)).alias("n"))


@query(_with(ITEMS_SQL) + " SELECT a.label, round(max(sqrt(pow(a.ra - b.ra, 2) + pow(a.\"dec\" - b.\"dec\", 2))), 6) AS separation FROM items a JOIN items b ON a.label = b.label GROUP BY a.label")
def max_pairwise_distance(spark, d):
    """The two points farthest apart lie on the convex hull: hulls of batches, then of each group's hull points, then their pairs."""
    ship(spark)

    def hull(p: np.ndarray) -> np.ndarray:
        p = np.unique(p, axis=0)
        if len(p) < 4:
            return p
        out: list = []
        for part in (p, p[::-1]):
            chain: list = []
            for q in part:
                while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (q[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (q[0] - chain[-2][0]) <= 0:
                    chain.pop()
                chain.append(q)
            out += chain[:-1]
        return np.array(out)

    def partial(frames):
        for f in frames:
            for label, g in f.groupby("label"):
                h = hull(g[["ra", "dec"]].to_numpy())
                yield pd.DataFrame({"label": label, "ra": h[:, 0], "dec": h[:, 1]})

    def widest(f: pd.DataFrame) -> pd.DataFrame:
        h = hull(f[["ra", "dec"]].to_numpy())
        return pd.DataFrame({"label": [f["label"].iloc[0]], "separation": [float(np.sqrt(((h[:, None] - h[None]) ** 2).sum(-1)).max())]})

    few = items(spark, d).select("label", "ra", "dec").mapInPandas(partial, "label int, ra double, dec double")
    return rounded(few.groupBy("label").applyInPandas(widest, "label int, separation double"))


@query("SELECT label, round(degrees(atan2(median(embedding[3]::DOUBLE) - median(embedding[2]::DOUBLE), median(embedding[1]::DOUBLE) + median(embedding[4]::DOUBLE))), 6) AS angle FROM embeddings GROUP BY label")
def median_orientation(spark, d):
    m = lambda i: F.median(F.try_element_at("embedding", F.lit(i)).cast("double"))
    return rounded(table(spark, d, "embeddings").groupBy("label").agg(F.degrees(F.atan2(m(3) - m(2), m(1) + m(4))).alias("angle")))


@query(_with(STACK_SQL, "r AS (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY frame, y, x) - 1 AS i, count(*) OVER (PARTITION BY pixel) AS n FROM s)", "t AS (SELECT DISTINCT pixel, floor(k * (n - 1) / 7.0)::BIGINT AS i FROM r, (SELECT unnest(range(8)) AS k))") + " SELECT pixel, round(median(value), 6) AS start, count(*) AS n FROM r JOIN t USING (pixel, i) GROUP BY pixel")
def sampled_start(spark, d):
    """Start values from at most eight evenly spaced frames of a key."""
    w = Window.partitionBy("pixel")
    r = stack(spark, d, "frame", "y", "x").withColumn("i", F.row_number().over(w.orderBy("frame", "y", "x")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    spots = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.floor(k * (F.col("n") - 1) / F.lit(7.0))))
    return rounded(r.where(F.array_contains(spots, F.col("i").cast("long"))).groupBy("pixel").agg(F.median("value").alias("start"), F.count("value").alias("n")))


@query("WITH r AS (SELECT s_suppkey AS frame, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier) SELECT frame, i // 16 AS sequential, i % 7 AS round_robin FROM r")
def pass_splitting(spark, d):
    r = table(spark, d, "supplier").select(F.col("s_suppkey").alias("frame")).withColumn("i", (F.row_number().over(Window.orderBy("frame")) - 1).cast("long"))  # a row for each frame
    return r.select("frame", F.floor(F.col("i") / 16).alias("sequential"), (F.col("i") % 7).alias("round_robin"))


@query(_with(STACK_SQL) + " SELECT frame, round(quantile_cont(value, 0.05), 6) AS low, round(quantile_cont(value, 0.7), 6) AS high, round(median(value), 6) AS median FROM s GROUP BY frame")
def sky_statistics(spark, d):
    return rounded(stack(spark, d, "frame").groupBy("frame").agg(F.percentile("value", F.lit(0.05)).alias("low"), F.percentile("value", F.lit(0.7)).alias("high"), F.median("value").alias("median")))


@query(_with(FITS_SQL, "g AS (SELECT j AS id, count(DISTINCT round(a, 6)) AS gains, bool_and(a = 0) AS zero FROM f GROUP BY j)") + " SELECT id, gains, zero OR gains = 1 AS degenerate FROM g")
def degenerate_solutions(spark, d):
    f = fits(spark, d).groupBy(F.col("j").alias("id")).agg(F.count_distinct(F.round("a", 6)).alias("gains"), F.bool_and(F.col("a") == 0).alias("zero"))
    return f.select("id", "gains", (F.col("zero") | (F.col("gains") == 1)).alias("degenerate"))


@query(_with(STACK_SQL, "v AS (SELECT frame, greatest(avg(value) / 60, 1.0) AS fwhm FROM s GROUP BY frame)") + " SELECT frame, round((SELECT min(fwhm) FROM v) / greatest(fwhm, 0.5), 6) AS weight FROM v")
def weights_fwhm(spark, d):
    v = stack(spark, d, "frame").groupBy("frame").agg(F.greatest(F.avg("value") / 60, F.lit(1.0)).alias("fwhm"))
    return rounded(v.crossJoin(F.broadcast(v.agg(F.min("fwhm").alias("best")))).select("frame", (F.col("best") / F.greatest("fwhm", F.lit(0.5))).alias("weight")))


_HEAD = "h AS (SELECT s_suppkey AS id, (s_suppkey % 13 - 6) / 3600.0 AS cd11, (s_suppkey % 5 - 1) / 36000.0 AS cd12, (s_suppkey % 3) / 36000.0 AS cd21, (s_suppkey % 11 - 5) / 3600.0 AS cd22, CASE WHEN s_suppkey % 17 <> 0 THEN s_acctbal END AS crval, CASE WHEN s_suppkey % 19 <> 0 THEN 'RA---TAN' END AS ctype FROM supplier), d AS (SELECT *, abs(cd11 * cd22 - cd12 * cd21) AS det FROM h)"


@query("WITH " + _HEAD + " SELECT CASE WHEN ctype IS NULL OR ctype NOT LIKE 'RA%' THEN 'ctype' WHEN crval IS NULL THEN 'crval' WHEN det < 1e-16 THEN 'singular' WHEN sqrt(det) * 3600 < 0.3 OR sqrt(det) * 3600 > 5 THEN 'scale' ELSE 'ok' END AS reason, count(*) AS n FROM d GROUP BY 1")
def wcs_validation(spark, d):
    """Ordered checks of a header's transformation; the first that fails names the reason."""
    k = F.col("s_suppkey")
    h = table(spark, d, "supplier").select(((k % 13 - 6) / 3600.0).alias("a"), ((k % 5 - 1) / 36000.0).alias("b"), (k % 3 / 36000.0).alias("c"), ((k % 11 - 5) / 3600.0).alias("e"), F.when(k % 17 != 0, F.col("s_acctbal")).alias("crval"), F.when(k % 19 != 0, "RA---TAN").alias("ctype"))
    h = h.withColumn("det", F.abs(F.col("a") * F.col("e") - F.col("b") * F.col("c")))
    scale = F.sqrt("det") * 3600
    reason = F.when(~F.coalesce(F.col("ctype").startswith("RA"), F.lit(False)), "ctype").when(F.col("crval").isNull(), "crval").when(F.col("det") < 1e-16, "singular").when((scale < 0.3) | (scale > 5), "scale").otherwise("ok")
    return h.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS removed, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS left_over FROM customer")
def header_key_removal(spark, d):
    """Keys removed by an exact set or a prefix, and how many."""
    even = F.col("c_custkey") % 2 == 0
    h = F.map_from_arrays(F.array(F.lit("CRVAL1"), F.when(even, F.lit("A_0_2")).otherwise(F.lit("OBJECT")), F.lit("EXPTIME")), F.array("c_name", "c_mktsegment", F.lit("30")))
    kept = F.map_filter(h, lambda k, v: ~k.isin("CRVAL1", "CRVAL2") & ~k.rlike("^[AB]P?_"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.size(h) - F.size(kept)).alias("removed"), F.size(kept).alias("left_over"))


@query(_with(BOXES_SQL, "c AS (SELECT avg((x0 + x1) / 2) AS cx, avg((y0 + y1) / 2) AS cy, median(y1 - y0) AS scale FROM boxes)") + " SELECT id, sqrt(pow((x0 + x1) / 2 - cx, 2) + pow((y0 + y1) / 2 - cy, 2)) > 400 AS far, abs((y1 - y0) / scale - 1) > 0.04 AS off_scale FROM boxes, c WHERE sqrt(pow((x0 + x1) / 2 - cx, 2) + pow((y0 + y1) / 2 - cy, 2)) > 400 OR abs((y1 - y0) / scale - 1) > 0.04")
def sanity_outliers(spark, d):
    b = boxes(spark, d).select("id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), (F.col("y1") - F.col("y0")).alias("h"))
    c = F.broadcast(b.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.median("h").alias("scale")))  # one row
    far = F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2) > 400
    return b.crossJoin(c).select("id", far.alias("far"), (F.abs(F.col("h") / F.col("scale") - 1) > 0.04).alias("off_scale")).where("far OR off_scale")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 640 WHEN event_id % 3 = 1 THEN 0 ELSE event_id % 50 + 1 END::INT AS width, CASE WHEN event_id % 3 = 0 THEN 480 WHEN event_id % 3 = 1 THEN 0 ELSE 9 END::INT AS height FROM events")
def resolution_parse(spark, d):
    k = F.col("event_id")
    text = F.when(k % 3 == 0, " 640 x 480").when(k % 3 == 1, "0x5").otherwise(F.concat((k % 50 + 1).cast("string"), F.lit("X9")))
    part = lambda i: F.regexp_extract(text, r"^\s*(\d+)\s*[xX]\s*(\d+)\s*$", i).try_cast("int")
    good = (part(1) > 0) & (part(2) > 0)
    return table(spark, d, "events").select("event_id", F.when(good, part(1)).otherwise(0).alias("width"), F.when(good, part(2)).otherwise(0).alias("height"))


@query("SELECT event_id, round(least(a, b), 6) AS low, round(greatest(a, b), 6) AS high, round(coalesce(least(greatest(value / 100, 0), 0.49), 0.05), 6) AS winsor FROM (SELECT event_id, value, least(greatest(value - 20, 0), 100) AS a, least(greatest(80 - value, 0), 100) AS b FROM events)")
def percentile_pair(spark, d):
    text = F.concat_ws(",", (F.col("value") - 20).cast("string"), (80 - F.col("value")).cast("string"))
    part = lambda i: C.clamp(C.finite(F.trim(F.split(text, ",")[i]).try_cast("double")), 0.0, 100.0)
    a, b = F.coalesce(part(0), F.lit(5.0)), F.coalesce(part(1), F.lit(85.0))
    return rounded(table(spark, d, "events").select("event_id", F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), C.winsor_limits(F.col("value") / 100, F.lit(0.05))[0].alias("winsor")))


_PLANE = "SELECT id, round((((ra - 180 + 540) % 360) - 180) * greatest(cos(radians(10.0)), 1e-6), 6) AS x, round(\"dec\" - 10, 6) AS y FROM items"


@query(_with(ITEMS_SQL) + " " + _PLANE)
def plane_projection(spark, d):
    dx = F.pmod(F.col("ra") - 180 + 180, F.lit(360.0)) - 180
    return rounded(items(spark, d).select("id", (dx * F.greatest(F.cos(F.radians(F.lit(10.0))), F.lit(1e-6))).alias("x"), (F.col("dec") - 10).alias("y")))


@query("WITH m AS (SELECT vec_id, list_min(list_transform(embedding, lambda v: greatest(v::DOUBLE, 0))) AS lo, list_max(list_transform(embedding, lambda v: greatest(v::DOUBLE, 0))) AS hi, embedding FROM embeddings) SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: CASE WHEN hi > lo THEN (greatest(v::DOUBLE, 0) - lo) / (hi - lo) ELSE 0 END)), 4) AS total, round(0.299 * embedding[1]::DOUBLE + 0.587 * embedding[2]::DOUBLE + 0.114 * embedding[3]::DOUBLE, 6) AS luminance FROM m")
def normalize01(spark, d):
    up = F.transform("embedding", lambda v: F.greatest(v.cast("double"), F.lit(0.0)))
    lo, hi = F.array_min("up"), F.array_max("up")
    scaled = F.transform("up", lambda v: F.when(F.col("hi") > F.col("lo"), (v - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0))
    e = lambda i: F.try_element_at("embedding", F.lit(i)).cast("double")
    t = table(spark, d, "embeddings").withColumn("up", up).withColumn("lo", lo).withColumn("hi", hi)
    return t.select("vec_id", F.round(F.aggregate(scaled, F.lit(0.0), lambda a, v: a + v), 4).alias("total"), F.round(0.299 * e(1) + 0.587 * e(2) + 0.114 * e(3), 6).alias("luminance"))


@query("SELECT count(*) FILTER (quality = 1) AS accepted, count(*) FILTER (quality <> 1 OR quality IS NULL) AS rejected, array_to_string(list_sort(list(doc_id) FILTER (quality = 0 AND toxic = 1))[1:5], ' ') AS worst FROM documents LEFT JOIN labels USING (doc_id)")
def quality_manifest(spark, d):
    """The manifest's counts, and its first five worst by id (a report)."""
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    ok = F.coalesce(F.col("quality") == 1, F.lit(False))
    worst = j.where("quality = 0 AND toxic = 1").orderBy("doc_id").limit(5).agg(F.array_join(F.sort_array(F.collect_list("doc_id")).cast("array<string>"), " ").alias("worst"))
    return j.agg(F.count(F.when(ok, 1)).alias("accepted"), F.count(F.when(~ok, 1)).alias("rejected")).crossJoin(worst)


@query("SELECT o_orderpriority, o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, round(percent_rank() OVER w, 6) AS pct FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 20")
def ranked_top(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"))
    total = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    r = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense"), F.percent_rank().over(w).alias("pct"), F.row_number().over(total).alias("place"))
    return rounded(r.where("place <= 20").drop("place"))


@query(_with(PAIRS_SQL, "c AS (SELECT i AS id FROM pairs WHERE strength > 0.5 UNION SELECT j FROM pairs WHERE strength > 0.5)") + " SELECT id FROM boxes WHERE id NOT IN (SELECT id FROM c)")
def unique_area(spark, d):
    p = pairs(spark, d).where("strength > 0.5")
    covered = p.select(F.explode(F.array("i", "j")).alias("id"))
    return boxes(spark, d).select("id").join(covered, "id", "left_anti")


@query(_with(BOXES_SQL, "r AS (SELECT * FROM boxes WHERE id = (SELECT min(id) FROM boxes))") + " SELECT b.id, round((least(b.x1, r.x1) - greatest(b.x0, r.x0)) * (least(b.y1, r.y1) - greatest(b.y0, r.y0)), 6) AS area FROM boxes b, r WHERE b.id <> r.id AND b.x0 < r.x1 AND r.x0 < b.x1 AND b.y0 < r.y1 AND r.y0 < b.y1")
def reference_overlap(spark, d):
    b = boxes(spark, d)
    r = F.broadcast(b.orderBy("id").limit(1).select(F.col("id").alias("r"), *[F.col(c).alias("r" + c) for c in ("x0", "x1", "y0", "y1")]))  # one row
    j = b.join(r, (F.col("id") != F.col("r")) & (F.col("x0") < F.col("rx1")) & (F.col("rx0") < F.col("x1")) & (F.col("y0") < F.col("ry1")) & (F.col("ry0") < F.col("y1")))
    side = lambda a: F.least(f"{a}1", f"r{a}1") - F.greatest(f"{a}0", f"r{a}0")
    return rounded(j.select("id", (side("x") * side("y")).alias("area")))


@query(_with(MODES_SQL, "c AS (SELECT label, avg(ra) AS x, avg(\"dec\") AS y, count(*) AS n FROM items GROUP BY label)", "t AS (SELECT median(n) AS target FROM c)", "p AS (SELECT a.label AS needy, b.label AS donor, row_number() OVER (PARTITION BY a.label ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.label) AS rank, target - a.n AS debt FROM c a JOIN c b ON a.label <> b.label, t WHERE a.n < target AND b.n > greatest(2, 0.6 * target))") + " SELECT needy, donor, rank, round(debt, 6) AS debt FROM p WHERE rank <= 3")
def donor_candidates(spark, d):
    c = items(spark, d).groupBy("label").agg(F.avg("ra").alias("x"), F.avg("dec").alias("y"), F.count(F.lit(1)).alias("n"))
    t = F.broadcast(c.agg(F.median("n").alias("target")))
    o = c.select(F.col("label").alias("donor"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("n").alias("on"))
    p = c.crossJoin(t).where("n < target").join(o, F.col("label") != F.col("donor")).where(F.col("on") > F.greatest(F.lit(2.0), 0.6 * F.col("target")))  # groups, not items
    far = F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2)
    rank = F.row_number().over(Window.partitionBy("label").orderBy(far, "donor")).cast("long")
    return rounded(p.select(F.col("label").alias("needy"), "donor", rank.alias("rank"), (F.col("target") - F.col("n")).alias("debt")).where("rank <= 3"))


@query("SELECT min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1 FROM (SELECT x // 4 AS x, vec_id % 64 // 4 AS y, avg(v) AS m FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS x, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL) WHERE m > 0.01")
def autocrop_box(spark, d):
    """Bounding box of pooled cells whose mean passes the gate."""
    p = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    c = p.groupBy(F.floor(F.col("x") / 4).alias("x"), F.floor(F.col("vec_id") % 64 / 4).alias("y")).agg(F.avg(F.col("v").cast("double")).alias("m")).where("m > 0.01")
    return c.agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))


@query("SELECT conv_id, turn, split_part(role, 'st', 1) AS prefix, CASE WHEN role = 'user' THEN 'human' ELSE 'other' END AS side FROM conversations")
def message_split(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.split_part("role", F.lit("st"), F.lit(1)).alias("prefix"), F.when(F.col("role") == "user", "human").otherwise("other").alias("side"))


@query("SELECT size, CASE WHEN size <= 200 THEN size WHEN size <= 1000 THEN 200 ELSE 100 END::BIGINT AS budget FROM (SELECT l_partkey, count(*) * 50 AS size FROM lineitem GROUP BY 1) GROUP BY size")
def footprint_budget(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_partkey").agg((F.count(F.lit(1)) * 50).alias("size")).select("size").distinct()
    return n.select("size", F.when(F.col("size") <= 200, F.col("size")).when(F.col("size") <= 1000, 200).otherwise(100).cast("long").alias("budget"))


@query(_with(MODES_SQL) + " SELECT id // 3 AS run_id, CASE WHEN count(*) FILTER (mode = 'UNKNOWN') = 0 AND count(DISTINCT mode) > 1 THEN 'split' ELSE 'whole' END AS run, count(DISTINCT mode) AS modes FROM g GROUP BY 1")
def mount_run_split(spark, d):
    """Separate outputs only where every frame's mount is known and both occur."""
    g = grouped(spark, d)
    both = (F.count(F.when(F.col("mode") == "UNKNOWN", 1)) == 0) & (F.count_distinct("mode") > 1)
    return g.groupBy(F.floor(F.col("id") / 3).alias("run_id")).agg(F.when(both, "split").otherwise("whole").alias("run"), F.count_distinct("mode").alias("modes"))


@query("SELECT page_id FROM pages WHERE page_id % 3 <> 0 OR md5(url) > '8'")
def resume_misses(spark, d):
    """Results of an earlier run that are missing or no longer fit their input's fingerprint."""
    p = table(spark, d, "pages").select("page_id", F.md5("url").alias("print"))
    done = p.where("page_id % 3 = 0").select("page_id", F.when(F.col("print") <= "8", F.col("print")).otherwise("stale").alias("print"))
    return p.join(done, ["page_id", "print"], "left_anti").select("page_id")
