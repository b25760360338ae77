"""Queries on whole frames and tiles: predicates, dispatch by option, cleanup, and what is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators import robust as R
from lumenfold.operators import spatial as S
from lumenfold.plans import combine
from lumenfold.plans.base import STACK_SQL, registry, rounded, stack
from lumenfold.plans.graph import EDGES_SQL
from lumenfold.plans.spatial import BOXES_SQL, CELL, boxes, global_grid_descriptor
from lumenfold.plans.spatial import SQL as SPATIAL_SQL
from lumenfold.session import new_path, table
from lumenfold.sources.plans import write_csv

QUERIES, SQL, query = registry()


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


def again(df: DataFrame, name: str, kind: str = "parquet", packed: str = "none", **options) -> DataFrame:
    """Written to the shared folder in a format and read again with the same columns; text may be ``packed``."""
    path = new_path(df.sparkSession, name)
    if kind == "csv":
        write_csv(df, path, packed)
        options = {"header": True} | options
    else:
        df.write.format(kind).save(path)
    return df.sparkSession.read.format(kind).options(**options).schema(df.schema).load(path)


@query(_with(STACK_SQL, "f AS (SELECT frame, count(DISTINCT channel) AS planes, max(x) AS width FROM s GROUP BY frame)", "r AS (SELECT planes, width FROM f ORDER BY frame LIMIT 1)") + " SELECT frame, f.planes, f.width FROM f JOIN r ON f.planes = r.planes AND f.width = r.width")
def shape_consistency(spark, d):
    """Frames of the first frame's shape: planes and width of all of their samples."""
    f = stack(spark, d, "frame", "channel", "x").groupBy("frame").agg(F.count_distinct("channel").alias("planes"), F.max("x").alias("width"))
    first = f.agg(F.min_by(F.struct("planes", "width"), "frame").alias("r")).select("r.*")  # one row
    return f.join(F.broadcast(first), ["planes", "width"]).select("frame", "planes", "width")


@query(_with(STACK_SQL) + " SELECT pixel, count(value) > 0 AND max(value) > min(value) AS usable FROM s GROUP BY pixel")
def signal_predicate(spark, d):
    v = F.col("value")
    return stack(spark, d).groupBy("pixel").agg(((F.count(v) > 0) & (F.max(v) > F.min(v))).alias("usable"))


@query("SELECT event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events WHERE value > 0 AND user_id % 3 = 0 GROUP BY event_type")
def first_valid(spark, d):
    """Of each type the first row in input order that has all it needs; a type without one has no row."""
    ok = (F.col("value") > 0) & (F.col("user_id") % 3 == 0)
    return table(spark, d, "events").where(ok).groupBy("event_type").agg(F.min("event_id").alias("event_id"), F.min_by("value", "event_id").alias("value"))


# 256 pixels and half of a mean side are fixed values, and so are the star limits below: they must equal the originals'
@query(_with(BOXES_SQL) + " SELECT id % 40 AS canvas, least(max(x1) - min(x0), max(y1) - min(y0)) < 256 OR least(max(x1) - min(x0), max(y1) - min(y0)) < 0.5 * avg((x1 - x0 + y1 - y0) / 2) AS degenerate FROM boxes GROUP BY id % 40")
def degenerate_canvas(spark, d):
    """A canvas with a side under 256 or under half of its frames' mean side."""
    side = F.least(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0"))
    mean = F.avg((F.col("x1") - F.col("x0") + F.col("y1") - F.col("y0")) / 2)
    return boxes(spark, d).groupBy((F.col("id") % 40).alias("canvas")).agg(((side < 256) | (side < 0.5 * mean)).alias("degenerate"))


STARS_SQL = "st AS (SELECT p_partkey AS id, p_size * 20.0 AS x, p_partkey % 1000 AS y, (p_partkey % 17) / 16.0 AS sharpness, (p_partkey % 11 - 5) / 10.0 AS roundness, p_retailprice AS flux FROM part)"


@query(_with(STARS_SQL) + " SELECT id, flux FROM st WHERE x BETWEEN 50 AND 950 AND y BETWEEN 50 AND 950 AND sharpness BETWEEN 0.3 AND 0.95 AND abs(roundness) < 0.3 ORDER BY flux DESC, id LIMIT 100")
def source_star_filter(spark, d):
    """Sources away from the border, sharp and round; the hundred brightest (the feature, not a cap)."""
    k = F.col("p_partkey")
    inside = (F.col("p_size") * 20).between(50, 950) & (k % 1000).between(50, 950)
    fine = (k % 17 / 16.0).between(0.3, 0.95) & (F.abs((k % 11 - 5) / 10.0) < 0.3)
    return table(spark, d, "part").where(inside & fine).select(k.alias("id"), F.col("p_retailprice").alias("flux")).orderBy(F.desc("flux"), "id").limit(100)


FALLOFF_SQL = "p AS (SELECT s_suppkey AS id, sqrt(pow((x0 + x1) / 2 - 500, 2) + pow((y0 + y1) / 2 - 500, 2)) / 500 AS r FROM (SELECT s_suppkey, (s_acctbal + 1000) / 11 - 60 AS x0, (s_acctbal + 1000) / 11 + 60 AS x1, s_nationkey * 40.0 - 45 - s_suppkey % 7 AS y0, s_nationkey * 40.0 + 45 + s_suppkey % 5 AS y1 FROM supplier)), t AS (SELECT id, least(greatest((r - 0.6) / 0.35, 0), 1) AS t FROM p)"


def falloff(r, inner: float = 0.6, outer: float = 0.95):
    """1 inside the inner radius, 0 outside the outer one, a smooth step between."""
    t = F.least(F.greatest((r - inner) / (outer - inner), F.lit(0.0)), F.lit(1.0))
    return 1 - t * t * (3 - 2 * t)


def radius(b: DataFrame):
    return F.sqrt(((F.col("x0") + F.col("x1")) / 2 - 500) ** 2 + ((F.col("y0") + F.col("y1")) / 2 - 500) ** 2) / 500


@query(_with(FALLOFF_SQL) + " SELECT id, round(1 - t * t * (3 - 2 * t), 6) AS mask FROM t")
def radial_falloff(spark, d):
    b = boxes(spark, d)
    return rounded(b.select("id", falloff(radius(b)).alias("mask")))


@query(_with(FALLOFF_SQL) + " SELECT id, CASE WHEN 1 - t * t * (3 - 2 * t) > 1e-3 THEN round(s_acctbal * (1 - t * t * (3 - 2 * t)), 6) END AS cleaned, s_acctbal < 0 AND t > 0 AS dim FROM t JOIN supplier ON s_suppkey = id")
def border_cleanup(spark, d):
    """Samples under a falloff mask; those that it leaves nothing of are missing. A dim one is negative out of the inner radius."""
    b = boxes(spark, d)
    m = falloff(radius(b))
    return rounded(b.select("id", F.when(m > 1e-3, F.col("s_acctbal") * m).alias("cleaned"), ((F.col("s_acctbal") < 0) & (m < 1)).alias("dim")))


@query("SELECT vec_id, len(p) AS corners, round(coalesce(list_sum(list_transform(p, lambda x: x[1] + x[2])), 0), 6) AS total FROM (SELECT vec_id, list_filter([[e[1], e[2]], [e[3], e[4]], [e[5], e[6]], [e[7], e[8]]], lambda x: isfinite(x[1]) AND isfinite(x[2]) AND abs(x[2]) <= 1) AS p FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))")
def footprint_sanitize(spark, d):
    """Corner pairs in any number: those of two finite numbers, the second within its range."""
    e = lambda i: F.try_element_at("embedding", F.lit(i)).cast("double")
    pairs = F.array(*[F.struct(e(i).alias("a"), e(i + 1).alias("b")) for i in (1, 3, 5, 7)])
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    kept = table(spark, d, "embeddings").select("vec_id", F.filter(pairs, lambda p: finite(p["a"]) & finite(p["b"]) & (F.abs(p["b"]) <= 1)).alias("p"))
    return rounded(kept.select("vec_id", F.size("p").cast("long").alias("corners"), F.aggregate("p", F.lit(0.0), lambda t, p: t + p["a"] + p["b"]).alias("total")))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN '-' WHEN event_type = 'click' THEN printf('%.1f MB', round(value, 1)) WHEN event_type = 'view' THEN printf('%d', round(value)::BIGINT) ELSE printf('%.2f', round(value, 2)) END AS shown FROM events")
def optional_format(spark, d):
    """MB, whole number or two decimals by field; a dash where there's none."""
    v = F.when(F.col("event_id") % 4 != 3, F.col("value"))
    by = F.when(F.col("event_type") == "click", F.format_string("%.1f MB", F.round(v, 1))).when(F.col("event_type") == "view", F.format_string("%d", F.round(v).cast("long"))).otherwise(F.format_string("%.2f", F.round(v, 2)))
    return table(spark, d, "events").select("event_id", F.when(v.isNull(), "-").otherwise(by).alias("shown"))


@query("SELECT id FROM (SELECT p_partkey AS id FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10) UNION SELECT id FROM (SELECT p_partkey AS id FROM part ORDER BY p_size DESC, p_partkey LIMIT 10) UNION SELECT id FROM (SELECT l_partkey AS id FROM lineitem GROUP BY l_partkey ORDER BY count(*) DESC, l_partkey LIMIT 10)")
def label_selection(spark, d):
    """What gets a label: the first ten by each of three metrics, once."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_retailprice", "p_size")
    n = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    top = lambda df, by: df.orderBy(F.desc(by), "id").limit(10).select("id")
    return top(p, "p_retailprice").union(top(p, "p_size")).union(top(n, "n")).distinct()


def coadd(s: DataFrame, keys: list[str], method: str = "mean") -> DataFrame:
    """keys and value by ``method``: mean, median, winsor or kappa; any other name is the mean."""
    if method == "median":
        return R.combine(s, keys, "median").select(*keys, "value")
    if method == "winsor":
        return R.coadd_winsor(s, keys, (0.05, 0.1)).select(*keys, "value")
    if method == "kappa":
        return R.coadd_kappa(s, keys, 1.5).select(*keys, "value")
    return R.coadd_mean(s, keys).select(*keys, "value")


COADDS = {"mean": "coadd_mean", "median": "stack_median", "winsor": "coadd_winsor", "kappa": "coadd_kappa_twopass", "unknown": "coadd_mean"}


@query(" UNION ALL ".join(f"SELECT '{m}' AS method, pixel, value FROM ({combine.SQL[q]})" for m, q in COADDS.items()))
def coadd_dispatch(spark, d):
    s, out = stack(spark, d), None
    for m in COADDS:
        one = coadd(s, ["pixel"], m).select(F.lit(m).alias("method"), "pixel", "value")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("SELECT lang || '/' || source AS folder, count(*) FILTER (doc_id % 13 = 0) > 0 AS grid FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1")
def grid_mode_detection(spark, d):
    """Whether a folder (a language's source) holds a plan (every 13th document is one)."""
    docs = table(spark, d, "documents").select(F.concat("lang", F.lit("/"), "source").alias("folder"), "doc_id").where("folder is not null")
    plan = docs.where("doc_id % 13 = 0").select("folder").distinct().withColumn("has", F.lit(True))
    return docs.select("folder").distinct().join(plan, "folder", "left").select("folder", F.coalesce("has", F.lit(False)).alias("grid"))


@query(_with(STACK_SQL, "a AS (SELECT s_suppkey AS frame, (s_suppkey % 5) / 4.0 AS alpha FROM supplier WHERE s_suppkey % 3 > 0)") + " SELECT pixel, round(avg(CASE WHEN coalesce(alpha, 1) > 0 THEN value END), 6) AS value, round(avg(coalesce(alpha, 1)), 6) AS alpha FROM s LEFT JOIN a USING (frame) GROUP BY pixel")
def optional_alpha(spark, d):
    """Frames with a mask of their own where they have one; samples of alpha 0 are missing, frames without a mask whole."""
    k = F.col("s_suppkey")
    mask = table(spark, d, "supplier").where(k % 3 > 0).select(k.alias("frame"), (k % 5 / 4.0).alias("alpha"))
    a = F.coalesce("alpha", F.lit(1.0))
    return rounded(stack(spark, d, "frame").join(mask, "frame", "left").groupBy("pixel").agg(F.avg(F.when(a > 0, F.col("value"))).alias("value"), F.avg(a).alias("alpha")))


@query(SPATIAL_SQL["global_grid_descriptor"])
def grid_descriptor_round_trip(spark, d):
    """The global grid as one JSON row, written and loaded again."""
    return again(global_grid_descriptor(spark, d), "grid", "json")


PLANES_SQL = "m AS (SELECT channel, min(value) AS lo, max(value) AS hi FROM s GROUP BY channel)"


@query(_with(STACK_SQL, PLANES_SQL, "u AS (SELECT pixel, channel, avg(round(65535 * (value - lo) / (hi - lo))) AS v, count(*) AS n FROM s JOIN m USING (channel) GROUP BY ALL)") + " SELECT pixel, round(max(v) FILTER (channel = 'R'), 6) AS r, round(max(v) FILTER (channel = 'A'), 6) AS a, round(max(v) FILTER (channel = 'N'), 6) AS n, least(255, 64 * sum(n))::BIGINT AS alpha FROM u GROUP BY pixel")
def uint16_planes_round_trip(spark, d):
    """Planes scaled to whole numbers by their own range, pivoted to columns beside an alpha of eight bits, written and read."""
    s = stack(spark, d, "channel")
    m = s.groupBy("channel").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    v = F.round(65535 * (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    u = s.join(F.broadcast(m), "channel").groupBy("pixel", "channel").agg(F.avg(v).alias("v"), F.count(F.lit(1)).alias("n"))  # a row a channel
    plane = lambda c: F.max(F.when(F.col("channel") == c, F.col("v"))).alias(c.lower())
    return again(rounded(u.groupBy("pixel").agg(*map(plane, "RAN"), F.least(F.lit(255), 64 * F.sum("n")).cast("long").alias("alpha"))), "planes")


@query(_with(EDGES_SQL) + " SELECT i, j, round(w, 6) AS w, round(strength, 6) AS strength FROM e")
def overlap_csv_round_trip(spark, d):
    """The overlap graph as text with a header, and back with its types. Its rows grow with the square of the boxes, so it is packed: the
    overlaps of equal boxes follow each other."""
    e = S.equal_pairs(boxes(spark, d), CELL).select("a_ids", "b_ids", "same", F.col("area").alias("w"), "strength")
    return again(S.told_apart(rounded(e)), "overlaps", "csv", "gzip")


@query("SELECT page_id, CASE WHEN page_id % 3 > 0 THEN length(html) % 50 END AS y0, CASE WHEN page_id % 3 > 0 THEN page_id % 40 END AS x0, CASE WHEN page_id % 3 > 0 THEN length(html) % 50 + 100 END AS y1, CASE WHEN page_id % 3 > 0 THEN page_id % 40 + 100 END AS x1 FROM pages")
def crop_csv_round_trip(spark, d):
    """A row a file with its rectangle; blanks where none was found."""
    p = table(spark, d, "pages")
    y, x = F.length("html") % 50, F.col("page_id") % 40
    found = p.where("page_id % 3 > 0").select("page_id", y.cast("long").alias("y0"), x.alias("x0"), (y + 100).cast("long").alias("y1"), (x + 100).alias("x1"))
    return again(p.select("page_id").join(found, "page_id", "left"), "crops", "csv")


@query("WITH l AS (SELECT s_suppkey AS id, s_acctbal AS score FROM supplier) SELECT CASE WHEN score < 4000 THEN 'accepted' ELSE 'rejected' END AS state, count(*) AS n, round(min(score), 6) AS least, round(max(score), 6) AS most FROM l GROUP BY 1")
def manifest_round_trip(spark, d):
    """accepted[], rejected[] and scores{} of all items, a JSON row for each state and shard, written, read and summed up."""
    score = F.col("s_acctbal")
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), score.alias("score"), F.when(score < 4000, "accepted").otherwise("rejected").alias("state"))
    shards = rows.groupBy("state", F.pmod(F.xxhash64("id"), F.lit(64)).alias("shard")).agg(F.map_from_entries(F.collect_list(F.struct("id", "score"))).alias("scores"))
    back = again(shards.select("state", "scores"), "manifest", "json").select("state", F.explode("scores").alias("id", "score"))
    return rounded(back.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.max("score").alias("most")))


TRIM_SQL = "c AS (SELECT l_returnflag AS channel, l_linenumber AS col, avg(l_extendedprice) AS m FROM lineitem GROUP BY ALL), md AS (SELECT channel, median(m) AS md FROM c GROUP BY channel), ma AS (SELECT channel, md, median(abs(m - md)) AS mad FROM c JOIN md USING (channel) GROUP BY ALL), b AS (SELECT col, bool_or(m > md + 1.5 * mad) AS bright FROM c JOIN ma USING (channel) GROUP BY col)"


@query(_with(TRIM_SQL) + " SELECT min(col) AS x0, max(col) AS x1 FROM b WHERE NOT bright")
def color_edge_trim(spark, d):
    """The columns that stay when each side gives way while any channel of it is brighter than the median by so many
    deviations: from the first to the last that isn't."""
    c = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("channel"), F.col("l_linenumber").alias("col")).agg(F.avg("l_extendedprice").alias("m"))
    w = Window.partitionBy("channel")  # strips of a picture: as many as it has columns
    far = c.withColumn("md", F.median("m").over(w)).withColumn("mad", F.median(F.abs(F.col("m") - F.col("md"))).over(w))
    b = far.groupBy("col").agg(F.bool_or(F.col("m") > F.col("md") + 1.5 * F.col("mad")).alias("bright"))
    return b.where("NOT bright").agg(F.min("col").alias("x0"), F.max("col").alias("x1"))


@query("WITH e AS (SELECT *, CASE WHEN octet_length(encode(props)) = 0 OR props IS NULL THEN 0 ELSE 1 END AS has FROM events) SELECT CASE WHEN user_id % 5 = 0 THEN 'reject' ELSE 'use' END AS state, count(*) AS n, round(sum(CASE WHEN isfinite(value) THEN value ELSE 0 END), 4) AS total FROM e GROUP BY 1")
def coverage_sanitize(spark, d):
    """Coverage of an unexpected shape is rejected as a whole; elsewhere what isn't finite is 0."""
    v = F.col("value")
    clean = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v).otherwise(0.0)
    state = F.when(F.col("user_id") % 5 == 0, "reject").otherwise("use").alias("state")
    return rounded(table(spark, d, "events").groupBy(state).agg(F.count(F.lit(1)).alias("n"), F.sum(clean).alias("total")), 4)
