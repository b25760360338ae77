"""Queries of sources and sinks: what the tables say is written as a user's files, and read again by the library."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenfold.functions import columns as C
from lumenfold.operators import edges as E
from lumenfold.plans.base import registry, rounded
from lumenfold.plans.edges import BAND, PIXELS_SQL, _crop_sql, pixels
from lumenfold.plans.spatial import ITEMS_SQL, items
from lumenfold.plans.streams import stream
from lumenfold.session import new_path, table
from lumenfold.sources import plans as S

QUERIES, SQL, query = registry()


@query(
    "SELECT 'tile-' || s_suppkey || '.fits' AS file_path, CASE WHEN s_suppkey % 7 = 0 THEN 1.0 ELSE round(s_acctbal, 2) END::DOUBLE AS exposure, 'night ' || s_nationkey AS batch_id, s_suppkey AS \"order\", CASE s_suppkey % 3 WHEN 0 THEN 'EQ' WHEN 1 THEN 'ALTZ' END AS mount FROM supplier WHERE s_suppkey % 11 <> 0"
)
def stack_plan_rows(spark, d):
    """A plan with names and a separator of its own, bad exposures and rows without a path."""
    k, path = F.col("s_suppkey"), new_path(spark, "stack-plan")
    t = table(spark, d, "supplier").select(
        F.when(k % 11 != 0, F.concat(F.lit(" tile-"), k.cast("string"), F.lit(".fits "))).alias(" FileName"), F.when(k % 7 == 0, "n/a").otherwise(F.round("s_acctbal", 2).cast("string")).alias("ExpTime"),
        F.concat(F.lit("night "), F.col("s_nationkey").cast("string")).alias("Session"), k.cast("string").alias("SEQ"), F.when(k % 3 == 0, "EQ").when(k % 3 == 1, "altaz").otherwise("?").alias("EqMode"),
    )
    t.write.csv(path, header=True, sep=";")
    return S.read_stack_plan(spark, path).select("file_path", "exposure", "batch_id", F.col("order").cast("long").alias("order"), "mount")


@query("SELECT kind, CASE WHEN kind = 'missing' THEN 0 ELSE count(DISTINCT n_regionkey) END AS resolved, count(DISTINCT n_regionkey) AS rows FROM nation, (SELECT unnest(['absolute', 'windows', 'relative', 'name', 'missing']) AS kind) GROUP BY kind")
def plan_paths(spark, d):
    """Paths of a plan as they are, without a drive, under the plan's folder and by name alone; one kind is nowhere."""
    folder = new_path(spark, "frames")
    table(spark, d, "nation").repartition("n_regionkey").write.partitionBy("n_regionkey").json(folder)
    files = S.list_files(spark, folder, (".json",)).select("path")
    at, base = F.regexp_replace("path", "^file:/*", "/"), folder.removeprefix("file://")
    inner, name = F.expr(f"substring({'regexp_replace(path, ' + repr('^file:/*') + ', ' + repr('/') + ')'}, {len(base) + 2})"), F.element_at(F.split("path", "/"), -1)
    tries = {"absolute": at, "windows": F.concat(F.lit("D:\\"), F.regexp_replace(inner, "/", "\\\\")), "relative": inner, "missing": F.concat(F.lit("lost-"), name)}
    rows = files.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("p")) for k, v in tries.items()])).alias("e")).select("e.*")
    flat = new_path(spark, "frames")  # by name alone a file is found beside the plan
    table(spark, d, "nation").repartition("n_regionkey").write.partitionBy("n_regionkey").json(flat)
    beside = S.list_files(spark, flat, (".json",)).select("path")
    found = S.resolve_paths(rows, "p", files, base).select("kind", "resolved")
    own = beside.select(F.lit("name").alias("kind"), F.concat(F.lit("/elsewhere/"), F.element_at(F.split("path", "/"), -1)).alias("p"), F.regexp_replace(F.col("path"), "/[^/]*$", "").alias("dir"))
    # each of these lies in a folder of its own, so its plan's folder differs: the listing is told as if it were one
    listing = beside.select(F.concat(F.lit(flat.removeprefix("file://") + "/"), F.element_at(F.split("path", "/"), -1)).alias("path"))
    found = found.unionByName(S.resolve_paths(own.select("kind", "p"), "p", listing, flat.removeprefix("file://")).select("kind", "resolved"))
    return found.groupBy("kind").agg(F.count("resolved").alias("resolved"), F.count(F.lit(1)).alias("rows"))


@query("SELECT o_orderpriority AS folder, 1 AS files FROM orders GROUP BY 1")
def folder_listing(spark, d):
    """A crawl of nested folders by suffix."""
    folder = new_path(spark, "archive")
    table(spark, d, "orders").select("o_orderkey", "o_orderpriority").repartition("o_orderpriority").write.partitionBy("o_orderpriority").parquet(folder)
    files = S.list_files(spark, folder, (".PARQUET",)).select(F.url_decode(F.regexp_extract("path", "o_orderpriority=([^/]*)/", 1)).alias("folder"))
    return files.groupBy("folder").agg(F.count(F.lit(1)).cast("int").alias("files"))


@query(
    "SELECT 'tile-' || s_suppkey AS path, round(CASE WHEN s_suppkey % 4 = 0 THEN CASE WHEN s_suppkey % 8 <> 0 THEN s_nationkey * 10 + 1.0 END ELSE s_nationkey * 10.0 END, 6) AS ra, CASE WHEN s_suppkey % 8 = 0 THEN 0 ELSE 4 END AS corners, CASE WHEN s_suppkey % 5 <> 0 THEN 'camera ' || s_suppkey % 3 END AS instrument FROM supplier"
)
def catalogue_round_trip(spark, d):
    """A catalogue written and read: a missing centre is that of the corners, missing corners and headers stay so."""
    k, n, path = F.col("s_suppkey"), F.col("s_nationkey") * 10.0, new_path(spark, "catalogue")
    corners = F.array(*[F.struct((n + a).alias("ra"), F.lit(float(b)).alias("dec")) for a, b in ((0, 0), (2, 0), (2, 2), (0, 2))])
    header = F.map_filter(F.create_map(F.lit("INSTRUME"), F.when(k % 5 != 0, F.concat(F.lit("camera "), (k % 3).cast("string")))), lambda _, v: v.isNotNull())
    t = table(spark, d, "supplier").select(
        F.concat(F.lit("tile-"), k.cast("string")).alias("path"), F.lit(100).alias("width"), F.lit(80).alias("height"), F.when(k % 4 != 0, n).alias("ra"), F.when(k % 4 != 0, F.lit(1.0)).alias("dec"),
        F.when(k % 8 != 0, corners).otherwise(F.slice(corners, 1, 0)).alias("corners"), header.alias("header"),
    )
    S.write_csv(S.catalogue(t), path)
    return S.read_catalogue(spark, path).select("path", F.round("ra", 6).alias("ra"), F.size("corners").alias("corners"), F.try_element_at("header", F.lit("INSTRUME")).alias("instrument"))


@query("SELECT p_partkey AS path, rpad('OBJECT', 8, ' ') || ' = ' || p_brand AS line FROM part UNION ALL SELECT p_partkey, rpad('EXPTIME', 8, ' ') || ' = ' || p_size FROM part WHERE p_size % 2 = 0")
def header_dump(spark, d):
    """Headers as lines of text."""
    size = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string"))
    t = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.map_filter(F.create_map(F.lit("OBJECT"), F.col("p_brand"), F.lit("EXPTIME"), size), lambda _, v: v.isNotNull()).alias("header"))
    return S.header_lines(t)


@query(
    "SELECT c_custkey AS id, k AS name, CASE k WHEN 'segment' THEN c_mktsegment WHEN 'nation' THEN CASE WHEN c_custkey % 3 = 0 THEN 'own' ELSE n_name END WHEN 'limit' THEN CASE WHEN c_custkey % 2 = 0 THEN '9' ELSE '1' END END AS value FROM customer JOIN nation ON n_nationkey = c_nationkey, (SELECT unnest(['segment', 'nation', 'limit']) AS k) WHERE k <> 'segment' OR c_custkey % 2 = 0"
)
def profile_overlay(spark, d):
    """Defaults, a profile and a user's own settings as maps in one row: the last one that has a key wins."""
    k = F.col("c_custkey")
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    default = F.create_map(F.lit("nation"), F.col("n_name"), F.lit("limit"), F.lit("1"))
    profile = F.when(k % 2 == 0, F.create_map(F.lit("limit"), F.lit("9"), F.lit("segment"), F.col("c_mktsegment")))
    own = F.when(k % 3 == 0, F.create_map(F.lit("nation"), F.lit("own")))
    return j.select(k.alias("id"), F.explode(S.overlaid(default, profile, own)).alias("name", "value"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, count(*) AS blank FROM events GROUP BY 1")
def telemetry_appends(spark, d):
    """A stream's batches appended to a CSV of fixed fields, of which the stream lacks one, with its others after them."""
    path = new_path(spark, "telemetry")
    s = stream(spark, d).select("ts", "value", "event_type")
    s.writeStream.foreachBatch(lambda b, _: S.append_telemetry(b, ["event_type", "cpu"], path)).option("checkpointLocation", new_path(spark, "stream")).queryName(f"q{uuid.uuid4().hex}").trigger(availableNow=True).start().awaitTermination()
    t = spark.read.csv(path, header=True)
    if t.columns != ["event_type", "cpu", "ts", "value"]:
        raise ValueError(f"unexpected fields {t.columns}")
    return rounded(t.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("double")).alias("total"), F.count(F.when(F.col("cpu").isNull(), 1)).alias("blank")), 4)


@query("SELECT position, count(*) AS rows, count(v) FILTER (isfinite(v)) AS finite, round(sum(v) FILTER (isfinite(v)), 4) AS total FROM (SELECT vec_id, generate_subscripts(embedding, 1)::INT - 1 AS position, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY position")
def array_values(spark, d):
    """Arrays as rows of places and values."""
    a = S.array_rows(table(spark, d, "embeddings"), "vec_id", "embedding")
    return rounded(a.groupBy("position").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("finite"), F.sum(F.col("value").cast("double")).alias("total")), 4)


@query("WITH " + ITEMS_SQL + " SELECT a.id, round(degrees(2 * asin(least(1, sqrt(pow(sin(radians(b.\"dec\" - a.\"dec\") / 2), 2) + cos(radians(a.\"dec\")) * cos(radians(b.\"dec\")) * pow(sin(radians(b.ra - a.ra) / 2), 2))))), 5) AS far FROM items a JOIN items b ON b.id = a.id + 1")
def great_circle_steps(spark, d):
    """Degrees on the sphere from each item to the next."""
    i = items(spark, d)
    n = i.select((F.col("id") - 1).alias("id"), F.col("ra").alias("ra2"), F.col("dec").alias("dec2"))
    return i.join(n, "id").select("id", F.round(C.great_circle(F.col("ra"), F.col("dec"), F.col("ra2"), F.col("dec2")), 5).alias("far"))


@query(f"WITH z AS ({_crop_sql()}), {PIXELS_SQL} SELECT image, count(*) AS n, min(px.y - y0)::BIGINT AS y_least, max(px.x - x0)::BIGINT AS x_most, round(sum(r), 4) AS red FROM px JOIN z USING (image) WHERE px.y >= y0 AND px.y < y1 AND px.x >= x0 AND px.x < x1 GROUP BY image")
def crop_sink(spark, d):
    """Images cut to the boxes that their gates leave, written and read."""
    p, path = pixels(spark, d), new_path(spark, "cropped")
    S.write_cropped(p, E.autocrop(p, band=BAND, margin=2), path)
    return rounded(spark.read.parquet(path).groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("y_least"), F.max("x").alias("x_most"), F.sum("r").alias("red")), 4)
