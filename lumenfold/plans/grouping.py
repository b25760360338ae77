"""Queries of grouping and batching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.operators import grouping as G
from lumenfold.operators import merging
from lumenfold.plans.base import registry, rounded
from lumenfold.plans.spatial import ITEMS_SQL, items

QUERIES, SQL, query = registry()
MODES_SQL = ITEMS_SQL + ", g AS (SELECT *, CASE id % 5 WHEN 0 THEN 'EQ' WHEN 1 THEN 'EQ' WHEN 2 THEN 'ALT_AZ' ELSE 'UNKNOWN' END AS mode, label // 2 AS grp FROM items)"


def _with(*parts):
    return "WITH " + ", ".join(parts)


def grouped(spark, d):
    m = F.col("id") % 5
    return items(spark, d).select("*", F.when(m < 2, "EQ").when(m == 2, "ALT_AZ").otherwise("UNKNOWN").alias("mode"), F.floor(F.col("label") / 2).cast("int").alias("grp"))


@query(_with(MODES_SQL) + " SELECT grp, mode, count(*) AS n, min(id) AS first FROM g GROUP BY ALL")
def mount_split(spark, d):
    return grouped(spark, d).groupBy("grp", "mode").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@query(_with(MODES_SQL) + " SELECT label, CASE WHEN bool_or(mode = 'EQ') AND bool_or(mode = 'ALT_AZ') THEN 'MIXED' WHEN bool_or(mode = 'EQ') THEN 'EQ' WHEN bool_or(mode = 'ALT_AZ') THEN 'ALT_AZ' ELSE 'UNKNOWN' END AS signature FROM g GROUP BY label")
def group_signature(spark, d):
    has = lambda m: F.bool_or(F.col("mode") == m)
    sig = F.when(has("EQ") & has("ALT_AZ"), "MIXED").when(has("EQ"), "EQ").when(has("ALT_AZ"), "ALT_AZ").otherwise("UNKNOWN")
    return grouped(spark, d).groupBy("label").agg(sig.alias("signature"))


@query(
    _with(ITEMS_SQL, "a AS (SELECT label, id, CASE WHEN id % 11 <> 0 THEN (angle % 360 + 360) % 360 END AS a FROM items)", "k AS (SELECT *, sum(CASE WHEN a - p > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY a, id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, lag(a) OVER (PARTITION BY label ORDER BY a, id) AS p FROM a WHERE a IS NOT NULL))",
          "i AS (SELECT label, id, CASE WHEN k = max(k) OVER w AND min(a) OVER w + 360 - max(a) OVER w <= 2 THEN 0 ELSE k END::BIGINT AS island FROM k WINDOW w AS (PARTITION BY label))", "z AS (SELECT label, island, count(*) AS n FROM i GROUP BY ALL)", "l AS (SELECT label, arg_min(island, {'n': -n, 'i': island}) AS island FROM z GROUP BY label)")
    + " SELECT label, id, island FROM i UNION ALL SELECT a.label, id, coalesce(island, 0) FROM a LEFT JOIN l USING (label) WHERE a IS NULL"
)
def orientation_islands(spark, d):
    i = items(spark, d).select("label", "id", F.when(F.col("id") % 11 != 0, F.col("angle")).alias("angle"))
    return G.orientation_islands(i, "label", "angle", "id", 2.0)


@query(
    _with(ITEMS_SQL, "p AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY ra NULLS LAST, \"dec\" NULLS LAST, id) - 1 AS position, count(*) OVER (PARTITION BY label) AS size FROM items)", "l AS (SELECT *, CASE WHEN size <= 12 THEN 0 ELSE ceil((size - 12) / 9)::BIGINT END AS last FROM p)",
          "b AS (SELECT *, unnest(range(greatest(0, ceil((position - 11) / 9))::BIGINT, least(position // 9, last) + 1)) AS batch FROM l)")
    + " SELECT DISTINCT label, id, position, CASE WHEN size - last * 9 < 5 AND last > 0 AND batch = last THEN last - 1 ELSE batch END::BIGINT AS batch FROM b"
)
def overlap_batches(spark, d):
    i = items(spark, d).select("label", "id", "ra", "dec")
    order = [F.col("ra").asc_nulls_last(), F.col("dec").asc_nulls_last(), F.col("id")]
    return G.overlapping_batches(i, "label", order, 12, 0.25, 5).select("label", "id", "position", "batch").distinct()


BORROW_SQL = (
    "c AS (SELECT label AS grp, avg(ra) AS cx, avg(\"dec\") AS cy, count(*) AS n FROM items GROUP BY label)",
    "i AS (SELECT id, label AS grp, ra AS x, \"dec\" AS y, cx, cy, n, sqrt(pow(ra - cx, 2) + pow(\"dec\" - cy, 2)) AS r FROM items JOIN c ON label = grp)",
    "q AS (SELECT grp, quantile_cont(r, 0.9) AS p90 FROM i GROUP BY grp)",
    "near AS (SELECT * FROM (SELECT a.grp, b.grp AS target, b.cx AS ox, b.cy AS oy, row_number() OVER (PARTITION BY a.grp ORDER BY sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)), b.grp) AS k FROM c a JOIN c b ON a.grp <> b.grp) WHERE k <= 4)",
    "t AS (SELECT i.grp, id, r, n, arg_min(target, {'d': sqrt(pow(x - ox, 2) + pow(y - oy, 2)), 't': target}) AS target FROM i JOIN q USING (grp) JOIN near USING (grp) WHERE r >= 0.8 * p90 GROUP BY ALL)",
)


@query(_with(ITEMS_SQL, *BORROW_SQL) + " SELECT id, grp AS home, target FROM (SELECT *, row_number() OVER (PARTITION BY grp, target ORDER BY r DESC, id) AS p FROM t) WHERE p <= ceil(0.25 * n)")
def borrow_v1(spark, d):
    return G.borrow(items(spark, d).select("id", F.col("label").alias("grp"), F.col("ra").alias("x"), F.col("dec").alias("y")))


@query(_with(ITEMS_SQL, "z AS (SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM items GROUP BY label, id % 3) GROUP BY size)", "r AS (SELECT *, row_number() OVER (ORDER BY n DESC, size DESC) AS rank FROM z)") + " SELECT string_agg(size || 'x' || n, ', ' ORDER BY rank) FILTER (rank <= 6) AS top, count(*) FILTER (rank > 6) AS tail FROM r")
def size_histogram(spark, d):
    z = items(spark, d).groupBy("label", F.col("id") % 3).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    r = z.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("size"))))  # one row for each size
    text = F.concat(F.col("size").cast("string"), F.lit("x"), F.col("n").cast("string"))
    first = F.array_sort(F.collect_list(F.when(F.col("rank") <= 6, F.struct("rank", text.alias("t")))))
    return r.agg(F.array_join(F.transform(first, lambda e: e["t"]), ", ").alias("top"), F.count(F.when(F.col("rank") > 6, 1)).alias("tail"))


@query(_with(ITEMS_SQL, "s AS (SELECT label, stddev_pop(ra) + stddev_pop(\"dec\") AS v FROM items GROUP BY label)") + " SELECT label, least(greatest(CASE WHEN v / 400 <= 0.12 THEN 0.10 WHEN v / 400 <= 0.30 THEN 0.15 WHEN v / 400 <= 0.60 THEN 0.05 ELSE 0.20 END, 0.08), 0.2)::DOUBLE AS threshold FROM s")
def threshold_heuristic(spark, d):
    s = items(spark, d).groupBy("label").agg((F.stddev_pop("ra") + F.stddev_pop("dec")).alias("v"))
    v = F.col("v") / 400
    # The steps from dispersion to threshold.
    ladder = F.when(v <= 0.12, 0.10).when(v <= 0.30, 0.15).when(v <= 0.60, 0.05).otherwise(0.20)
    return s.select("label", F.least(F.greatest(ladder, F.lit(0.08)), F.lit(0.2)).alias("threshold"))


@query(_with(ITEMS_SQL) + " SELECT label, round(min(ra), 6) AS x0, round(max(ra), 6) AS x1, round(min(\"dec\"), 6) AS y0, round(max(\"dec\"), 6) AS y1, count(*) AS n FROM items GROUP BY label")
def group_outlines(spark, d):
    return rounded(items(spark, d).groupBy("label").agg(F.min("ra").alias("x0"), F.max("ra").alias("x1"), F.min("dec").alias("y0"), F.max("dec").alias("y1"), F.count(F.lit(1)).alias("n")))


@query(
    _with(ITEMS_SQL, "p AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY ra NULLS LAST, \"dec\" NULLS LAST, id) - 1 AS position, count(*) OVER (PARTITION BY label) AS size FROM items)", "l AS (SELECT *, CASE WHEN size <= 12 THEN 0 ELSE ceil((size - 12) / 9)::BIGINT END AS last FROM p)",
          "b AS (SELECT *, unnest(range(greatest(0, ceil((position - 11) / 9))::BIGINT, least(position // 9, last) + 1)) AS batch FROM l)", "m AS (SELECT DISTINCT label, id, batch FROM b)", "n AS (SELECT label, batch, count(*) AS size FROM m GROUP BY ALL)", "o AS (SELECT a.label, a.batch, count(*) AS shared FROM m a JOIN m b ON a.label = b.label AND a.id = b.id AND b.batch = a.batch - 1 GROUP BY ALL)")
    + " SELECT label, batch, size, coalesce(shared, 0) AS shared FROM n LEFT JOIN o USING (label, batch)"
)
def batch_overlap_summary(spark, d):
    i = items(spark, d).select("label", "id", "ra", "dec")
    b = G.overlapping_batches(i, "label", [F.col("ra").asc_nulls_last(), F.col("dec").asc_nulls_last(), F.col("id")], 12, 0.25, 0).select("label", "id", "batch")
    before = F.lag("batch").over(Window.partitionBy("label", "id").orderBy("batch"))
    m = b.withColumn("both", (F.coalesce(before, F.lit(-9)) == F.col("batch") - 1))
    return m.groupBy("label", "batch").agg(F.count(F.lit(1)).alias("size"), F.count(F.when(F.col("both"), 1)).alias("shared"))


@query(None)
def orientation_greedy(spark, d):
    """Buckets by the first member's angle, in order of id, within each group."""
    return G.greedy_orientation(items(spark, d).select("label", "id", "angle"), "label", "angle", "id", 15.0)


@query(None)
def small_group_merge(spark, d):
    """Small groups are taken in by the nearest of their mount that has room; a row for each group that began."""
    code = F.when(F.col("mode") == "EQ", 0).when(F.col("mode") == "ALT_AZ", 1).otherwise(2)
    g = grouped(spark, d).withColumn("grp", (F.col("label") * 3 + code).cast("long"))
    into = merging.absorb(g.select("id", "grp", "mode", "ra", "dec"), least=12, cap=60).select("id", F.floor(F.col("grp") / 3).cast("int").alias("into"))
    return g.select("id", "mode", "label").join(into, "id").select("mode", "label", "into").distinct()


@query(
    "WITH RECURSIVE " + ITEMS_SQL + ", c AS (SELECT label, id, list_transform(range(9), lambda k: (floor(ra / 45)::INT + k // 3) * 16 + floor((\"dec\" + 90) / 22.5)::INT + k % 3) AS cells, row_number() OVER (PARTITION BY label ORDER BY id) AS p FROM items),"
    " r AS (SELECT label, p, id, 0 AS batch, 1 AS n, list_distinct(cells) AS seen FROM c WHERE p = 1 UNION ALL SELECT c.label, c.p, c.id, CASE WHEN r.n >= 5 AND len(r.seen) >= 0.92 * 80 OR r.n >= 20 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.n >= 5 AND len(r.seen) >= 0.92 * 80 OR r.n >= 20 THEN 1 ELSE r.n + 1 END,"
    " CASE WHEN r.n >= 5 AND len(r.seen) >= 0.92 * 80 OR r.n >= 20 THEN list_distinct(c.cells) ELSE list_distinct(list_concat(r.seen, c.cells)) END FROM r JOIN c ON c.label = r.label AND c.p = r.p + 1),"
    " l AS (SELECT label, batch, count(*) AS n, bool_or(n >= 5 AND len(seen) >= 0.92 * 80 OR n >= 20) AS closed FROM r GROUP BY label, batch) SELECT label, id, CASE WHEN r.batch > 0 AND NOT closed AND l.n < 5 THEN r.batch - 1 ELSE r.batch END::BIGINT AS batch FROM r JOIN l USING (label, batch)"
)
def coverage_batches(spark, d):
    """Batches that close when a grid is covered enough, in order of id within each group."""
    x, y = F.floor(F.col("ra") / 45).cast("int"), F.floor((F.col("dec") + 90) / 22.5).cast("int")
    i = items(spark, d).withColumn("cells", F.array(*[(x + a) * 16 + y + b for a in range(3) for b in range(3)]))
    return G.coverage_batches(i, "label", "id", "cells", total=80, least=5, target=20, share=0.92)
