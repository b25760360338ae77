"""Queries of filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import columns as C
from lumenfold.plans.base import STACK_SQL, registry, rounded, stack
from lumenfold.session import table

QUERIES, SQL, query = registry()


@query("SELECT label, count(*) AS n, count(*) FILTER (v IS NOT NULL AND isfinite(v) AND abs(v) > 1e-3) AS valid FROM (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label")
def valid_mask(spark, d):
    v = table(spark, d, "embeddings").select("label", F.explode("embedding").alias("v"))
    return v.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.abs(C.finite(F.col("v"))) > 1e-3, 1)).alias("valid"))


DEAD_SQL = f"WITH {STACK_SQL}, a AS (SELECT frame, channel, count(*) FILTER (value > 150) AS n, count(*) AS total FROM s GROUP BY ALL), f AS (SELECT frame, sum(n) / sum(total) AS share, min(n) AS least FROM a GROUP BY frame), r AS (SELECT frame, CASE WHEN share < 0.5 THEN 'finite' WHEN least < 175 THEN 'channel' ELSE 'kept' END AS reason FROM f)"


@query(DEAD_SQL + " SELECT reason, count(*) AS frames, min(frame) AS first FROM r GROUP BY reason")
def dead_frames(spark, d):
    """Frames with too few usable samples, over all or in a channel, by reason; usable is above 150 here."""
    a = stack(spark, d, "frame", "channel").groupBy("frame", "channel").agg(F.count(F.when(F.col("value") > 150, 1)).alias("n"), F.count(F.lit(1)).alias("total"))
    f = a.groupBy("frame").agg((F.sum("n") / F.sum("total")).alias("share"), F.min("n").alias("least"))
    reason = F.when(F.col("share") < 0.5, "finite").when(F.col("least") < 175, "channel").otherwise("kept")
    return f.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("frames"), F.min("frame").alias("first"))


@query("SELECT CASE WHEN n_chars IS NULL THEN 'missing size' WHEN n_chars < 400 THEN 'too small' WHEN n_chars > 8000 THEN 'too large' WHEN lang NOT IN ('en', 'de') THEN 'mode' ELSE 'valid' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def header_validation_reason(spark, d):
    n = F.col("n_chars")
    reason = F.when(n.isNull(), "missing size").when(n < 400, "too small").when(n > 8000, "too large").when(~F.col("lang").isin("en", "de"), "mode").otherwise("valid")
    return table(spark, d, "documents").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT page_id, lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z]+://', '')) AS key, len(list_filter(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z]+://', ''), '/'), lambda x: x <> '')) AS segments FROM pages")
def path_normalize(spark, d):
    plain = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-zA-Z]+://", "")
    return table(spark, d, "pages").select("page_id", F.lower(plain).alias("key"), F.size(F.filter(F.split(plain, "/"), lambda x: x != "")).cast("long").alias("segments"))


@query(r"SELECT page_id FROM pages WHERE len(list_filter(string_split(lower(url), '/'), lambda x: x IN ('fr', 'es', 'rejected', 'tmp'))) = 0")
def excluded_dirs(spark, d):
    parts = F.split(F.lower("url"), "/")
    return table(spark, d, "pages").where(F.size(F.array_intersect(parts, F.array(*[F.lit(x) for x in ("fr", "es", "rejected", "tmp")]))) == 0).select("page_id")


@query("SELECT s_suppkey AS id, CASE WHEN t IN ('eq', 'equatorial', 'gem', 'german') THEN 'EQ' WHEN t IN ('altz', 'alt-az', 'alt/az', 'alt-azm', 'altaz', 'altitude-azimuth') THEN 'ALTZ' END AS mount, CASE s_nationkey % 4 WHEN 1 THEN 'EQ' WHEN 0 THEN 'ALT_AZ' WHEN 2 THEN 'EQMODE_2' ELSE 'UNKNOWN' END AS mode FROM (SELECT *, lower(trim(CASE s_suppkey % 5 WHEN 0 THEN ' EQ ' WHEN 1 THEN 'AltAz' WHEN 2 THEN 'German' WHEN 3 THEN 'dobson' END)) AS t FROM supplier)")
def mount_normalize(spark, d):
    k, n = F.col("s_suppkey") % 5, F.col("s_nationkey") % 4
    text = F.when(k == 0, " EQ ").when(k == 1, "AltAz").when(k == 2, "German").when(k == 3, "dobson")
    eqmode = F.when(n < 3, n.cast("string")).otherwise("x")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), C.mount(text).alias("mount"), C.mount_mode(eqmode).alias("mode"))


@query("SELECT o_orderkey, round(epoch_us(o_orderdate) / 86400e6, 6) AS day FROM orders")
def date_to_ordinal(spark, d):
    k = F.col("o_orderkey") % 4
    stamp = F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format(stamp, "dd/MM/yyyy HH:mm:ss")).otherwise(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"))
    return rounded(table(spark, d, "orders").select("o_orderkey", C.epoch_days(text).alias("day")))


@query("SELECT event_id, CASE WHEN v < 0 THEN '+' ELSE '' END || printf('%02d:%02d:%02d', (s // 3600), (s % 3600) // 60, s % 60) AS eta FROM (SELECT event_id, v, floor(abs(v) + 0.5)::BIGINT AS s FROM (SELECT event_id, value * 97.3 - 1000 AS v FROM events))")
def eta_hms(spark, d):
    return table(spark, d, "events").select("event_id", C.eta_hms(F.col("value") * 97.3 - 1000).alias("eta"))


@query("SELECT event_id, round(coalesce(CASE WHEN isfinite(f) THEN f END, -1), 6) AS number, coalesce(CASE WHEN isfinite(f) THEN trunc(f)::BIGINT END, 7) AS whole, coalesce(CASE WHEN event_type IN ('click', 'view') THEN t = 'yes' END, event_id % 2 = 0) AS flag FROM (SELECT *, try_cast(x AS DOUBLE) AS f, CASE event_type WHEN 'click' THEN 'yes' WHEN 'view' THEN 'no' END AS t FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN '12.5' WHEN 1 THEN 'abc' WHEN 2 THEN 'nan' ELSE event_id::VARCHAR END AS x FROM events))")
def safe_cast(spark, d):
    k = F.col("event_id") % 4
    text = F.when(k == 0, "12.5").when(k == 1, "abc").when(k == 2, "nan").otherwise(F.col("event_id").cast("string"))
    flag = F.when(F.col("event_type") == "click", " Yes ").when(F.col("event_type") == "view", "off").otherwise("?")
    even = F.col("event_id") % 2 == 0
    return rounded(table(spark, d, "events").select("event_id", C.safe_float(text, -1.0).alias("number"), C.safe_int(text, 7).alias("whole"), F.coalesce(F.when(flag != "?", C.boolish(flag, False)), even).alias("flag")))


@query("SELECT s_suppkey AS id, round((s_suppkey % 24 + (s_suppkey % 60) / 60.0 + (s_suppkey * 7 % 60) / 3600.0) * 15, 6) AS ra, round(CASE WHEN s_suppkey % 2 = 0 THEN -1 ELSE 1 END * (s_suppkey % 90 + (s_suppkey % 60) / 60.0 + (s_suppkey * 7 % 60) / 3600.0), 6) + 0.0 AS \"dec\" FROM supplier")
def sexagesimal(spark, d):
    k = F.col("s_suppkey")
    ra = F.format_string("%dh%dm%ds", k % 24, k % 60, k * 7 % 60)
    dec = F.concat(F.when(k % 2 == 0, "-").otherwise(""), F.format_string("%d°%d'%ds", k % 90, k % 60, k * 7 % 60))
    return table(spark, d, "supplier").select(k.alias("id"), F.round(C.sexagesimal(ra, True), 6).alias("ra"), (F.round(C.sexagesimal(dec, False), 6) + 0.0).alias("dec"))


LIMITS_SQL = f"WITH {STACK_SQL}, l AS (SELECT channel, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.998) AS hi FROM s GROUP BY channel)"


def _limits(s):
    return F.broadcast(s.groupBy("channel").agg(F.percentile("value", F.lit(0.005)).alias("lo"), F.percentile("value", F.lit(0.998)).alias("hi")))  # a row for each channel


@query(LIMITS_SQL + " SELECT y, x, pixel, round(asinh(least(greatest((value - lo) / nullif(hi - lo, 0), 0), 1) / 0.1) / asinh(10.0), 6) AS shown FROM s JOIN l USING (channel)")
def asinh_stretch(spark, d):
    s = stack(spark, d, "channel", "y", "x")
    return rounded(s.join(_limits(s), "channel").select("y", "x", "pixel", C.asinh_stretch(F.col("value"), F.col("lo"), F.col("hi"), 0.1).alias("shown")))


@query(LIMITS_SQL + " SELECT y, x, pixel, floor(least(greatest((value - lo) / nullif(hi - lo, 0), 0), 1) * 65535)::INT AS level, floor(least(greatest((value - lo) / nullif(hi - lo, 0), 0), 1) * 65535)::INT - 32768 AS shifted FROM s JOIN l USING (channel)")
def rescale_u16(spark, d):
    s = stack(spark, d, "channel", "y", "x")
    level = C.rescale_u16(F.col("value"), F.col("lo"), F.col("hi"))
    return s.join(_limits(s), "channel").select("y", "x", "pixel", level.alias("level"), (level - 32768).alias("shifted"))


# The weights of the score's terms by how much of the frame objects cover (below 0.20, below 0.50, else).
WEIGHTS = {
    0.20: {"cc": 0.18, "ed": 0.12, "sc": 0.22, "nbr": 0.10, "bu": 0.05, "sded": 0.12, "cec": 0.07, "cer": 0.14},
    0.50: {"cc": 0.17, "ed": 0.13, "sc": 0.25, "nbr": 0.11, "bu": 0.05, "sded": 0.09, "cec": 0.08, "cer": 0.12},
    9.99: {"cc": 0.16, "ed": 0.14, "sc": 0.28, "nbr": 0.12, "bu": 0.06, "sded": 0.00, "cec": 0.09, "cer": 0.15},
}
#: How each metric is bound to a document: SQL that both engines read alike.
METRICS = {
    "cc": "(n_chars % 89) / 89.0D", "ed": "(n_chars % 53) / 26.5D", "sc": "(n_chars % 71) / 142.0D", "nbr": "(n_chars % 31) / 155.0D", "bu": "(n_chars % 17) / 85.0D",
    "sded": "quality * 0.3D", "cec": "(n_chars % 13) / 6.5D", "cer": "(n_chars % 97) / 194.0D", "eoc": "least(n_chars / 10000.0D, 1.0D)", "trl": "toxic * 0.3D + (n_chars % 7) / 70.0D",
}


def _terms(w: dict[str, float]) -> str:
    loose = lambda k, f: f"{w[k]} * CASE WHEN trl > 0.25 THEN {f} ELSE 1 END"
    return (
        f"{w['cc']} * (1 - cc) + {loose('ed', 0.7)} * least(1, ed / 1.5) + {w['sc']} * sc + {w['nbr']} * nbr + {w['bu']} * bu"
        f" + {loose('sded', 0.3)} * sded + {w['cec']} * least(1, cec) + {w['cer']} * cer"
    )


QUALITY_SQL = (
    "WITH m AS (SELECT doc_id, " + ", ".join(f"{v.replace('D', '::DOUBLE')} AS {k}" for k, v in METRICS.items()) + " FROM documents JOIN labels USING (doc_id)), s AS (SELECT *, CASE "
    + " ".join(f"WHEN eoc < {limit} THEN {_terms(w)}" for limit, w in WEIGHTS.items()) + " END AS score FROM m), "
    "o AS (SELECT *, (cc >= 0.70 AND cer < 0.35 AND ed < 1.2) OR (cc >= 0.78 AND sc < 0.28 AND nbr < 0.10) OR (trl > 0.30 AND cer < 0.40 AND sc < 0.40) AS rescued FROM s)"
)


def _quality(spark, d):
    """Score and override of each labelled document, with its columns bound to the metrics of an image."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    m = j.select("doc_id", *[F.expr(v).alias(k) for k, v in METRICS.items()])
    c = F.col
    loose = F.when(c("trl") > 0.25, True).otherwise(False)
    score = None
    for limit, w in reversed(WEIGHTS.items()):
        terms = (
            w["cc"] * (1 - c("cc")) + w["ed"] * F.when(loose, 0.7).otherwise(1.0) * F.least(F.lit(1.0), c("ed") / 1.5) + w["sc"] * c("sc") + w["nbr"] * c("nbr") + w["bu"] * c("bu")
            + w["sded"] * F.when(loose, 0.3).otherwise(1.0) * c("sded") + w["cec"] * F.least(F.lit(1.0), c("cec")) + w["cer"] * c("cer")
        )
        score = F.when(c("eoc") < limit, terms) if score is None else F.when(c("eoc") < limit, terms).otherwise(score)
    # The three ways by which an image over the threshold is still accepted.
    well_covered = (c("cc") >= 0.70) & (c("cer") < 0.35) & (c("ed") < 1.2)
    good_overall = (c("cc") >= 0.78) & (c("sc") < 0.28) & (c("nbr") < 0.10)
    elongated = (c("trl") > 0.30) & (c("cer") < 0.40) & (c("sc") < 0.40)
    return m.withColumn("score", score).withColumn("rescued", well_covered | good_overall | elongated)


@query(QUALITY_SQL + " SELECT doc_id, round(score, 6) AS score, score <= 0.48 AS keep FROM o")
def quality_score(spark, d):
    return rounded(_quality(spark, d).select("doc_id", "score", (F.col("score") <= 0.48).alias("keep")))


@query(QUALITY_SQL + " SELECT doc_id, score <= 0.48 OR rescued AS accepted, rescued FROM o")
def accept_override(spark, d):
    return _quality(spark, d).select("doc_id", ((F.col("score") <= 0.48) | F.col("rescued")).alias("accepted"), "rescued")


@query("SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'Seestar S50' WHEN 1 THEN 'Seestar S30' WHEN 2 THEN 'ASIAIR' WHEN 3 THEN 'ZWO ASI 533' WHEN 4 THEN 'Canon 6D' END AS instrument FROM supplier")
def instrument_label(spark, d):
    k = F.col("s_suppkey") % 6
    creator = F.when(k == 0, "made by Seestar S50").when(k == 1, "seestar s30 app").when(k == 2, "ASIAIR")
    own = F.when(k == 3, "ZWO ASI 533").when(k == 4, " Canon 6D ").otherwise("")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), C.instrument(creator, own).alias("instrument"))


@query("SELECT c_custkey, substr(sha1(lower(c_name)), 1, 16) AS key, coalesce(nullif(trim(c_mktsegment), ''), c_name) AS stable FROM customer")
def lock_key(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.substring(F.sha1(F.lower("c_name")), 1, 16).alias("key"), F.coalesce(F.nullif(F.trim("c_mktsegment"), F.lit("")), "c_name").alias("stable"))
