"""Queries of reports, run comparisons and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.functions.columns import safe_div
from lumenfold.operators.selection import beside, quantiles
from lumenfold.plans.base import registry, rounded
from lumenfold.session import materialize, table

QUERIES, SQL, query = registry()
TELEMETRY_SQL = "t AS (SELECT coalesce(nullif(trim(CASE WHEN event_id % 13 = 0 THEN '  ' ELSE event_type END), ''), 'unknown') AS phase, value AS cpu, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS ram, ts FROM events)"


def telemetry(spark, d):
    """telemetry(phase, cpu, ram, ts); a blank phase is unknown."""
    blank = F.when(F.col("event_id") % 13 == 0, "  ").otherwise(F.col("event_type"))
    return table(spark, d, "events").select(F.coalesce(F.nullif(F.trim(blank), F.lit("")), F.lit("unknown")).alias("phase"), F.col("value").alias("cpu"), F.get_json_object("props", "$.k").try_cast("double").alias("ram"), F.col("ts").cast("timestamp").alias("ts"))


@query("WITH " + TELEMETRY_SQL + " SELECT phase, count(*) AS rows, round(avg(cpu), 6) AS cpu_mean, round(max(cpu), 6) AS cpu_max, count(cpu) AS cpu_n, round(max(ram / 100), 6) AS ram_max, round(avg(nullif(ram, 0)), 6) AS ram_mean FROM t GROUP BY phase")
def telemetry_rollup(spark, d):
    return rounded(telemetry(spark, d).groupBy("phase").agg(F.count(F.lit(1)).alias("rows"), F.avg("cpu").alias("cpu_mean"), F.max("cpu").alias("cpu_max"), F.count("cpu").alias("cpu_n"), F.max(F.col("ram") / 100).alias("ram_max"), F.avg(F.nullif("ram", F.lit(0.0))).alias("ram_mean")))


@query("WITH " + TELEMETRY_SQL + ", r AS (SELECT phase, max(cpu) AS cpu, max(ram) AS ram FROM t GROUP BY phase) SELECT phase, 'cpu' AS what, round(cpu, 6) AS peak FROM r WHERE cpu > 90 UNION ALL SELECT phase, 'ram', round(ram, 6) FROM r WHERE ram > 90")
def telemetry_warnings(spark, d):
    r = telemetry(spark, d).groupBy("phase").agg(F.max("cpu").alias("cpu"), F.max("ram").alias("ram"))
    each = F.explode(F.array(F.struct(F.lit("cpu").alias("what"), F.col("cpu").alias("peak")), F.struct(F.lit("ram").alias("what"), F.col("ram").alias("peak"))))
    return rounded(r.select("phase", each.alias("e")).select("phase", "e.what", "e.peak").where("peak > 90"))


@query("WITH a AS (SELECT l_orderkey AS y, l_linenumber AS x, l_extendedprice AS v FROM lineitem), b AS (SELECT l_orderkey AS y, l_linenumber AS x, l_extendedprice * (1 - l_discount) AS v FROM lineitem WHERE l_partkey % 50 <> 0), j AS (SELECT a.v AS va, b.v AS vb FROM (SELECT y, x, sum(v) AS v FROM a GROUP BY ALL) a FULL JOIN (SELECT y, x, sum(v) AS v FROM b GROUP BY ALL) b USING (y, x)) SELECT count(*) AS cells, count(*) FILTER (va IS NULL OR vb IS NULL) AS unmatched, count(*) FILTER (va <> vb) AS nonzero, round(max(abs(va - vb)), 4) AS max_diff, round(avg(abs(va - vb)), 4) AS mean_diff, round(quantile_cont(abs(va - vb), 0.99), 4) AS p99 FROM j")
def run_compare(spark, d):
    """Two runs cell by cell: both sums in one pass, and the exact share by selection."""
    t, first, second = table(spark, d, "lineitem"), F.col("l_extendedprice"), F.when(F.col("l_partkey") % 50 != 0, F.col("l_extendedprice") * (1 - F.col("l_discount")))
    j = materialize(t.groupBy("l_orderkey", "l_linenumber").agg(F.sum(first).alias("va"), F.sum(second).alias("vb")), "cells")
    diff = F.abs(F.col("va") - F.col("vb"))
    told = j.agg(F.count(F.lit(1)).alias("cells"), F.count(F.when(F.col("va").isNull() | F.col("vb").isNull(), 1)).alias("unmatched"), F.count(F.when(F.col("va") != F.col("vb"), 1)).alias("nonzero"), F.max(diff).alias("max_diff"), F.avg(diff).alias("mean_diff"))
    return rounded(told.crossJoin(quantiles(j, [], diff, {"p99": 0.99})), 4)  # one row each


@query("WITH a AS (SELECT o_orderpriority || '/' || o_orderstatus AS key, count(*) AS v FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1), b AS (SELECT o_orderpriority || '/' || o_orderstatus AS key, count(*) AS v FROM orders WHERE o_custkey % 3 <> 1 GROUP BY 1) SELECT key, a.v AS before, b.v AS after FROM a FULL JOIN b USING (key) WHERE a.v IS DISTINCT FROM b.v")
def config_diff(spark, d):
    key = F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("key")
    side = lambda r, name: table(spark, d, "orders").where(F.col("o_custkey") % 3 != r).groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return side(0, "before").join(side(1, "after"), "key", "full").where(~F.col("before").eqNullSafe(F.col("after")))


@query("SELECT 'raw' AS name, round(min(l_quantity), 6) AS low, round(median(l_quantity), 6) AS median, round(max(l_quantity), 6) AS high, round(avg(l_quantity), 6) AS mean, count(*) AS rows FROM lineitem UNION ALL SELECT 'effective', round(min(l_quantity * (1 - l_discount)), 6), round(median(l_quantity * (1 - l_discount)), 6), round(max(l_quantity * (1 - l_discount)), 6), round(avg(l_quantity * (1 - l_discount)), 6), count(*) FROM lineitem")
def weight_summary(spark, d):
    q = F.col("l_quantity")
    each = F.explode(F.array(F.struct(F.lit("raw").alias("name"), q.alias("v")), F.struct(F.lit("effective").alias("name"), (q * (1 - F.col("l_discount"))).alias("v"))))
    u = table(spark, d, "lineitem").select(each.alias("e")).select("e.name", "e.v")
    told = u.groupBy("name").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.count("v").alias("rows"))
    return rounded(beside(told, u, ["name"], "v", {"median": 0.5}))


@query("SELECT label, count(*) AS elements, count(*) FILTER (v IS NOT NULL AND isfinite(v)) AS finite, round(min(v), 6) AS low, round(median(v), 6) AS median, round(max(v), 6) AS high FROM (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label")
def array_summary(spark, d):
    from lumenfold.functions.columns import finite

    v = table(spark, d, "embeddings").select("label", F.explode("embedding").alias("e")).withColumn("v", finite(F.col("e")))
    told = v.groupBy("label").agg(F.count(F.lit(1)).alias("elements"), F.count("v").alias("finite"), F.min("v").alias("low"), F.max("v").alias("high"))
    return rounded(beside(told, v, ["label"], "v", {"median": 0.5}))


@query("WITH n AS (SELECT role, conv_id, turn, try_cast(nullif(regexp_extract(text, '([0-9]+)', 1), '') AS DOUBLE) AS v, length(text) AS size FROM conversations), s AS (SELECT role, count(*) AS lines, count(v) AS found, round(median(size), 6) AS median, round(quantile_cont(size, 0.95), 6) AS p95, max(size) AS longest FROM n GROUP BY role), l AS (SELECT role, string_agg(conv_id || ':' || turn, ' ' ORDER BY conv_id DESC, turn DESC) AS last FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC, size DESC) AS r FROM n) WHERE r <= 3 GROUP BY role) SELECT * FROM s JOIN l USING (role)")
def log_regex_summary(spark, d):
    n = table(spark, d, "conversations").select("role", "conv_id", "turn", F.nullif(F.regexp_extract("text", "([0-9]+)", 1), F.lit("")).try_cast("double").alias("v"), F.length("text").alias("size"))
    s = n.groupBy("role").agg(F.count(F.lit(1)).alias("lines"), F.count("v").alias("found"), F.max("size").cast("long").alias("longest"))
    s = beside(s, n, ["role"], "size", {"median": 0.5, "p95": 0.95})
    rank = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("conv_id"), F.desc("turn"), F.desc("size")))
    last = n.withColumn("r", rank).where("r <= 3").groupBy("role").agg(F.sort_array(F.collect_list(F.struct("conv_id", "turn")), asc=False).alias("l"))
    text = F.array_join(F.transform("l", lambda e: F.concat(e["conv_id"].cast("string"), F.lit(":"), e["turn"].cast("string"))), " ")
    return rounded(s.join(last, "role").select(*s.columns, text.alias("last")))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1 WHERE l.doc_id IS NULL")
def cache_miss_antijoin(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_anti")


@query("SELECT lower(regexp_replace(url, '[?#].*$', '')) AS path, count(*) AS n, arg_min(page_id, {'s': -length(html), 'p': page_id}) AS page_id, max(length(html)) AS size FROM pages GROUP BY 1")
def dedupe_files(spark, d):
    p = table(spark, d, "pages").select(F.lower(F.regexp_replace("url", "[?#].*$", "")).alias("path"), "page_id", F.length("html").cast("long").alias("size"))
    return p.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min_by("page_id", F.struct(-F.col("size"), F.col("page_id"))).alias("page_id"), F.max("size").alias("size"))


@query("WITH c AS (SELECT lower(c_mktsegment) AS key, arg_max(c_custkey, c_custkey) AS custkey FROM customer GROUP BY 1), o AS (SELECT c_mktsegment AS raw, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1) SELECT raw, n, custkey FROM o LEFT JOIN c ON lower(raw) = key")
def lookup_join(spark, d):
    c = table(spark, d, "customer")
    last = c.groupBy(F.lower("c_mktsegment").alias("key")).agg(F.max("c_custkey").alias("custkey"))
    o = c.join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_mktsegment").alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    return o.join(last, F.lower("raw") == F.col("key"), "left").select("raw", "n", "custkey")


@query("SELECT r_name, count(DISTINCT c_custkey) AS customers, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name")
def catalogue_dimensions(spark, d):
    n = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    c = n.join(table(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return c.groupBy("r_name").agg(F.count_distinct("c_custkey").alias("customers"), F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT label, round(sqrt(coalesce(n / nullif(median(n) OVER (), 0), 1)), 6) AS proxy FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def stack_weight_proxy(spark, d):
    n = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    m = F.broadcast(n.agg(F.median("n").alias("m")))
    return rounded(n.crossJoin(m).select("label", F.sqrt(F.coalesce(safe_div(F.col("n"), F.col("m")), F.lit(1.0))).alias("proxy")))


PHASES = {"click": 30, "view": 35, "purchase": 9, "scroll": 8}


@query("WITH w AS (SELECT event_type, count(*) AS n, avg(value) AS v FROM events GROUP BY 1) SELECT round(sum(w * least(v / 100, 1)) / sum(w), 6) AS progress, sum(w)::BIGINT AS weights FROM (SELECT *, CASE event_type WHEN 'click' THEN 30 WHEN 'view' THEN 35 WHEN 'purchase' THEN 9 WHEN 'scroll' THEN 8 ELSE 2 END AS w FROM w)")
def weighted_progress(spark, d):
    w = F.lit(2)
    for name, weight in PHASES.items():
        w = F.when(F.col("event_type") == name, weight).otherwise(w)
    g = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("v")).withColumn("w", w)
    return rounded(g.agg((F.sum(F.col("w") * F.least(F.col("v") / 100, F.lit(1.0))) / F.sum("w")).alias("progress"), F.sum("w").cast("long").alias("weights")))
