"""Queries of normalisation and weighting."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions.columns import safe_div
from lumenfold.operators import normalize as N
from lumenfold.operators.robust import clipped_stats
from lumenfold.operators.selection import quantiles
from lumenfold.plans.base import STACK_SQL, registry, rounded, stack
from lumenfold.plans.combine import _clipped
from lumenfold.session import table

QUERIES, SQL, query = registry()


def _with(*parts: str) -> str:
    return "WITH " + ", ".join([STACK_SQL, *parts])


def _percentiles(s, keys, low, high):
    return s.groupBy(*keys).agg(F.percentile("value", F.lit(low)).alias("low"), F.percentile("value", F.lit(high)).alias("high"))


def _reference(df, *names):
    """The first frame's row for each channel, renamed."""
    first = df.agg(F.min("frame").alias("first"))
    return df.crossJoin(F.broadcast(first)).where("frame = first").drop("frame", "first").withColumnsRenamed({n: f"ref_{n}" for n in names})


@query(
    _with(
        "p AS (SELECT frame, channel, quantile_cont(value, 0.25) AS low, quantile_cont(value, 0.9) AS high FROM s GROUP BY ALL)",
        "r AS (SELECT channel, low AS rl, high AS rh FROM p WHERE frame = (SELECT min(frame) FROM s))",
        "j AS (SELECT *, abs(high - low) < greatest(1e-3, 1e-3 * greatest(abs(low), abs(high), 1.0)) AS flat, CASE WHEN abs(high - low) < greatest(1e-3, 1e-3 * greatest(abs(low), abs(high), 1.0)) THEN 1.0 WHEN abs(rh - rl) > 1e-5 THEN (rh - rl) / (high - low) ELSE 1.0 END AS a FROM p JOIN r USING (channel))",
    )
    + " SELECT frame, channel, round(CASE WHEN abs(a) <= 10 THEN a ELSE 1 END, 6) AS a, round(CASE WHEN flat OR abs(a) > 10 THEN 0 ELSE rl - a * low END, 6) AS b FROM j"
)
def norm_linear_fit(spark, d):
    p = _percentiles(stack(spark, d, "frame", "channel"), ["frame", "channel"], 0.25, 0.9)
    return rounded(N.linear_fit(p, _reference(p, "low", "high"), ["channel"]).select("frame", "channel", "a", "b"))


@query(
    _with(
        "p AS (SELECT frame, pixel // 64 AS cell, avg(value) FILTER (channel = 'R') AS r, avg(value) FILTER (channel = 'N') AS g, avg(value) FILTER (channel = 'A') AS b FROM s GROUP BY ALL)",
        "q AS (SELECT frame, quantile_cont(0.299 * r + 0.587 * g + 0.114 * b, 0.25) AS sky FROM p GROUP BY frame)",
    )
    + " SELECT frame, round((SELECT sky FROM q WHERE frame = (SELECT min(frame) FROM q)) - sky, 6) AS shift FROM q"
)
def norm_sky_mean(spark, d):
    mean = lambda k: F.avg(F.when(F.col("channel") == k, F.col("value")))
    p = stack(spark, d, "frame", "channel").groupBy("frame", F.floor(F.col("pixel") / 64).alias("cell")).agg(mean("R").alias("r"), mean("N").alias("g"), mean("A").alias("b"))
    q = p.groupBy("frame").agg(F.percentile(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"), F.lit(0.25)).alias("sky"))
    return rounded(q.crossJoin(F.broadcast(_reference(q, "sky"))).select("frame", (F.col("ref_sky") - F.col("sky")).alias("shift")))


@query(_with("z AS (SELECT frame, value - median(value) OVER (PARTITION BY pixel) AS v FROM s)") + " SELECT frame, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation, count(*) AS n FROM z GROUP BY frame")
def norm_median(spark, d):
    from pyspark.sql import Window

    s = stack(spark, d, "frame")
    v = F.col("value") - F.median("value").over(Window.partitionBy("pixel"))
    return rounded(s.select("frame", v.alias("v")).groupBy("frame").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"), F.count("v").alias("n")))


_BY_FRAME = _clipped("value", 5, "s").replace("PARTITION BY pixel", "PARTITION BY frame")


@query(_with(_BY_FRAME, "v AS (SELECT frame, any_value(sd) * any_value(sd) AS variance FROM z GROUP BY frame)") + " SELECT frame, round(variance, 4) AS variance, round(coalesce((SELECT min(variance) FROM v WHERE variance > 0) / CASE WHEN variance > 0 THEN variance END, 1e-6), 6) AS weight FROM v")
def weights_inverse_variance(spark, d):
    w = N.inverse_variance(stack(spark, d, "frame"), ["frame"])
    return w.select("frame", F.round("variance", 4).alias("variance"), F.round("weight", 6).alias("weight"))


@query(_with("v AS (SELECT frame, var_pop(value) AS variance FROM s GROUP BY frame)") + " SELECT frame, round(greatest(s_acctbal, 1e-3) / greatest(variance, 1e-8), 6) AS weight FROM v JOIN supplier ON frame = s_suppkey")
def frame_weight_exposure(spark, d):
    v = stack(spark, d, "frame").groupBy("frame").agg(F.var_pop("value").alias("variance"))
    f = table(spark, d, "supplier").select(F.col("s_suppkey").alias("frame"), F.col("s_acctbal").alias("exposure"))
    return rounded(v.join(f, "frame").select("frame", (F.greatest("exposure", F.lit(1e-3)) / F.greatest("variance", F.lit(1e-8))).alias("weight")))


@query("SELECT y, x, round(greatest(pow(cos(least(greatest(sqrt((y - 23.5) * (y - 23.5) + (x - 31.5) * (x - 31.5)) / (sqrt(48.0 * 48 + 64 * 64) / 2 * 0.9), 0), 1) * (pi() / 2)), 2.0), 0.05), 6) AS weight FROM (SELECT range AS y FROM range(48)) CROSS JOIN (SELECT range AS x FROM range(64))")
def radial_weight(spark, d):
    g = spark.range(48 * 64).select(F.floor(F.col("id") / 64).alias("y"), (F.col("id") % 64).alias("x"))
    return rounded(g.select("y", "x", N.radial_weight(F.col("y"), F.col("x"), 48, 64).alias("weight")))


@query(
    _with("p AS (SELECT frame, channel, median(value) AS med FROM s GROUP BY ALL)", "r AS (SELECT channel, med AS ref FROM p WHERE frame = (SELECT min(frame) FROM s))")
    + " SELECT frame, channel, round(coalesce(ref / nullif(med, 0), 1), 6) AS gain, round(ref - coalesce(ref / nullif(med, 0), 1) * med, 6) + 0.0 AS shift FROM p JOIN r USING (channel)"
)
def photometric_gain(spark, d):
    p = stack(spark, d, "frame", "channel").groupBy("frame", "channel").agg(F.median("value").alias("med"))
    j = p.join(F.broadcast(_reference(p, "med")), "channel")
    gain = F.coalesce(safe_div(F.col("ref_med"), F.col("med")), F.lit(1.0))
    return j.select("frame", "channel", F.round(gain, 6).alias("gain"), (F.round(F.col("ref_med") - gain * F.col("med"), 6) + 0.0).alias("shift"))


PAIRS = (
    "t AS (SELECT frame, pixel // 8 AS cell, avg(value) AS v FROM s GROUP BY ALL)",
    "p AS (SELECT a.frame AS frame, a.v AS x, b.v AS y FROM t a JOIN t b USING (cell) WHERE b.frame = (SELECT min(frame) FROM t) AND a.frame <> b.frame)",
)


def _pairs(spark, d):
    """Samples of each frame beside the reference frame's, on the cells that both have."""
    t = stack(spark, d, "frame").groupBy("frame", F.floor(F.col("pixel") / 8).alias("cell")).agg(F.avg("value").alias("v"))
    first = F.broadcast(t.agg(F.min("frame").alias("first")))
    both = t.crossJoin(first)
    ref = both.where("frame = first").select("cell", F.col("v").alias("y"))
    return both.where("frame <> first").select("frame", "cell", F.col("v").alias("x")).join(ref, "cell").select("frame", "x", "y")


@query(_with(*PAIRS) + " SELECT frame, round(coalesce(covar_pop(y, x) / nullif(var_pop(x), 0), 1), 6) AS gain, round(coalesce(avg(y) - covar_pop(y, x) / nullif(var_pop(x), 0) * avg(x), 0), 5) AS shift, count(*) AS n FROM p GROUP BY frame")
def linear_scale_fit(spark, d):
    f = N.ols(_pairs(spark, d), ["frame"])
    return f.select("frame", F.round(F.coalesce("slope", F.lit(1.0)), 6).alias("gain"), F.round(F.coalesce("intercept", F.lit(0.0)), 5).alias("shift"), "n")


def _regression_sql(sigma: float, rounds: int, least: int, stop: int) -> str:
    fit = "{p} AS (SELECT *, covar_pop(y, x) FILTER (k) OVER w / nullif(var_pop(x) FILTER (k) OVER w, 0) AS slope, avg(y) FILTER (k) OVER w AS my, avg(x) FILTER (k) OVER w AS mx, count(*) FILTER (k) OVER w AS n FROM {src} WINDOW w AS (PARTITION BY frame))"
    parts = [*PAIRS, f"k0 AS (SELECT *, true AS k, count(*) OVER (PARTITION BY frame) AS total, count(*) OVER (PARTITION BY frame) < {least} AS stopped FROM p)", fit.format(p="f0", src="k0")]
    for i in range(rounds):
        parts += [
            f"r{i} AS (SELECT * EXCLUDE (slope, my, mx, n), y - slope * x - (my - slope * mx) AS r FROM f{i})",
            f"s{i} AS (SELECT *, stddev_pop(r) FILTER (k) OVER (PARTITION BY frame) AS rs FROM r{i})",
            f"n{i} AS (SELECT *, k AND abs(r) <= {sigma} * rs AS nk FROM s{i})",
            f"c{i} AS (SELECT *, count(*) FILTER (nk) OVER (PARTITION BY frame) AS nn FROM n{i})",
            f"k{i + 1} AS (SELECT frame, x, y, total, stopped OR rs <= 1e-6 OR nn < {stop} AS stopped, CASE WHEN stopped OR rs <= 1e-6 OR nn < {stop} THEN k ELSE nk END AS k FROM c{i})",
            fit.format(p=f"f{i + 1}", src=f"k{i + 1}"),
        ]
    return _with(*parts) + (
        f" SELECT frame, round(any_value(CASE WHEN total < {least} THEN 1 ELSE coalesce(slope, 1) END), 6) AS gain, round(any_value(CASE WHEN total < {least} THEN 0 ELSE coalesce(my - slope * mx, 0) END), 5) AS \"offset\", any_value(n) AS n FROM f{rounds} GROUP BY frame"
    )


@query(_regression_sql(3.0, 1, 16, 16))
def overlap_regression_trim(spark, d):
    f = N.trimmed_regression(_pairs(spark, d), ["frame"])
    return f.select("frame", F.round("gain", 6).alias("gain"), F.round("offset", 5).alias("offset"), "n")


@query(_regression_sql(2.0, 6, 16, 8))
def robust_affine_fit(spark, d):
    f = N.iterated_regression(_pairs(spark, d), ["frame"], sigma=2.0)
    return f.select("frame", F.round("gain", 6).alias("gain"), F.round("offset", 5).alias("offset"), "n")


@query(
    _with(
        *PAIRS,
        "b AS (SELECT frame, quantile_cont((x + y) / 2, 0.1) AS lo, quantile_cont((x + y) / 2, 0.7) AS hi FROM p GROUP BY frame)",
        "i AS (SELECT p.* FROM p JOIN b USING (frame) WHERE (x + y) / 2 BETWEEN lo AND hi)",
        "g AS (SELECT frame, covar_pop(y, x) / nullif(var_pop(x), 0) AS a, avg(y) - covar_pop(y, x) / nullif(var_pop(x), 0) * avg(x) AS b, corr(y, x) AS c, stddev_pop(y) / nullif(stddev_pop(x), 0) AS ratio, median(y) AS my, median(x) AS mx, count(*) AS n FROM i GROUP BY frame)",
    )
    + " SELECT frame, round(CASE WHEN coalesce(c, 0) < 0.3 OR coalesce(a, 0) <= 0 THEN coalesce(ratio, 1) ELSE a END, 6) AS gain, round(CASE WHEN coalesce(c, 0) < 0.3 OR coalesce(a, 0) <= 0 THEN my - coalesce(ratio, 1) * mx ELSE b END, 5) AS shift, n FROM g"
)
def sky_affine_guard(spark, d):
    p = _pairs(spark, d).withColumn("mid", (F.col("x") + F.col("y")) / 2)
    band = p.groupBy("frame").agg(F.percentile("mid", F.lit(0.1)).alias("lo"), F.percentile("mid", F.lit(0.7)).alias("hi"))
    i = p.join(band, "frame").where("mid BETWEEN lo AND hi")
    sx, sy = F.stddev_pop("x"), F.stddev_pop("y")
    corr = safe_div(F.covar_pop("x", "y"), sx * sy)
    g = i.groupBy("frame").agg(safe_div(F.covar_pop("x", "y"), F.var_pop("x")).alias("a"), F.avg("x").alias("ax"), F.avg("y").alias("ay"), corr.alias("c"), safe_div(sy, sx).alias("ratio"), F.median("y").alias("my"), F.median("x").alias("mx"), F.count("x").alias("n"))
    bad = (F.coalesce("c", F.lit(0.0)) < 0.3) | (F.coalesce("a", F.lit(0.0)) <= 0)
    ratio = F.coalesce("ratio", F.lit(1.0))
    return g.select("frame", F.round(F.when(bad, ratio).otherwise(F.col("a")), 6).alias("gain"), F.round(F.when(bad, F.col("my") - ratio * F.col("mx")).otherwise(F.col("ay") - F.col("a") * F.col("ax")), 5).alias("shift"), "n")


@query(_with("m AS (SELECT frame, median(value) AS med FROM s GROUP BY frame)") + " SELECT frame, round(CASE WHEN med > 0 THEN (SELECT median(med) FROM m WHERE med > 0) / med ELSE 1 END, 6) AS gain FROM m")
def global_median_fallback(spark, d):
    m = stack(spark, d, "frame").groupBy("frame").agg(F.median("value").alias("med"))
    t = F.broadcast(m.where("med > 0").agg(F.median("med").alias("target")))
    return rounded(m.crossJoin(t).select("frame", F.when(F.col("med") > 0, F.col("target") / F.col("med")).otherwise(1.0).alias("gain")))


@query(_with("p AS (SELECT channel, quantile_cont(value - 280, 0.001) AS q FROM s GROUP BY channel)") + " SELECT channel, round(CASE WHEN q < 0 THEN q ELSE 0 END, 6) AS shift FROM p")
def coadd_background_shift(spark, d):
    p = quantiles(stack(spark, d, "channel"), ["channel"], F.col("value") - 280, {"q": 0.001})
    return rounded(p.select("channel", F.when(F.col("q") < 0, F.col("q")).otherwise(0.0).alias("shift")))
