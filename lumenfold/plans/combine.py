"""Queries of robust combination."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import robust as R
from lumenfold.operators.selection import beside, quantiles
from lumenfold.plans.base import STACK_SQL, registry, rounded, stack

QUERIES, SQL, query = registry()
K = ["pixel"]


def _with(*parts: str) -> str:
    return "WITH " + ", ".join([STACK_SQL, *parts])


KEPT = """ SELECT pixel, round(coalesce(sum(value * weight) FILTER (kept) / nullif(sum(weight) FILTER (kept), 0), avg(value)), 6) AS value,
 count(*) FILTER (kept) AS kept, round(100.0 * (count(*) - count(*) FILTER (kept)) / count(*), 6) AS rejected_pct FROM k GROUP BY pixel"""


def _clip_sql(of: str, low: float, high: float, tail: str = KEPT) -> str:
    """``of`` has value, m, sd."""
    return _with(*([of] if of else []), f"k AS (SELECT *, value >= m - {low} * sd AND value <= m + {high} * sd AS kept FROM z)") + tail


def _clipped(source: str, rounds: int, origin: str, name: str = "z") -> str:
    """CTEs that clip ``source`` about its median at 3 deviations, so many rounds."""
    parts = [f"r0 AS (SELECT *, {source} AS i FROM {origin})"]
    for k in range(rounds):
        parts.append(f"r{k + 1} AS (SELECT * REPLACE (CASE WHEN abs(i - mm) <= 3.0 * ss THEN i END AS i) EXCLUDE (mm, ss) FROM (SELECT *, median(i) OVER w AS mm, stddev_pop(i) OVER w AS ss FROM r{k} WINDOW w AS (PARTITION BY pixel)))".replace("* REPLACE (CASE WHEN abs(i - mm) <= 3.0 * ss THEN i END AS i) EXCLUDE (mm, ss)", "* EXCLUDE (i, mm, ss), CASE WHEN abs(i - mm) <= 3.0 * ss THEN i END AS i"))
    parts.append(f"{name} AS (SELECT *, median(i) OVER w AS m, stddev_pop(i) OVER w AS sd FROM r{rounds} WINDOW w AS (PARTITION BY pixel))")
    return ", ".join(parts)


WINS = "q AS (SELECT *, count(value) OVER w AS n, quantile_cont(value, {lo}) OVER w AS qlo, quantile_cont(value, {hi}) OVER w AS qhi FROM s WINDOW w AS (PARTITION BY pixel)), c AS (SELECT *, CASE WHEN n >= {least} THEN greatest(least(value, qhi), qlo) ELSE value END AS wins FROM q)"


@query(_with() + " SELECT pixel, round(avg(value), 6) AS value, count(value) AS n FROM s GROUP BY pixel")
def stack_mean(spark, d):
    return rounded(R.combine(stack(spark, d), K, "mean"))


@query(_with() + " SELECT pixel, round(median(value), 6) AS value, count(value) AS n FROM s GROUP BY pixel")
def stack_median(spark, d):
    return rounded(R.combine(stack(spark, d), K, "median"))


@query(_with() + " SELECT pixel, round(min(value), 6) AS low, round(max(value), 6) AS high, count(value) AS n FROM s GROUP BY pixel")
def stack_minmax(spark, d):
    return rounded(stack(spark, d).groupBy(*K).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n")))


@query(_with() + " SELECT pixel, round(coalesce(sum(value * weight) / nullif(sum(weight), 0), avg(value)), 6) AS value, count(value) AS n FROM s GROUP BY pixel")
def stack_weighted_mean(spark, d):
    return rounded(R.combine(stack(spark, d), K, "weighted"))


@query(_clip_sql("z AS (SELECT *, median(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM s WINDOW w AS (PARTITION BY pixel))", 1.5, 1.5))
def kappa_onepass_median(spark, d):
    return rounded(R.kept_mean(R.clip_once(stack(spark, d), K, 1.5, 1.5), K))


@query(_clip_sql("z AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM s WINDOW w AS (PARTITION BY pixel))", 2.0, 1.7))
def kappa_onepass_mean(spark, d):
    return rounded(R.kept_mean(R.clip_once(stack(spark, d), K, 2.0, 1.7, "mean"), K))


@query(_clip_sql(_clipped("value", 5, "s"), 1.9, 1.6))
def kappa_iterated(spark, d):
    return rounded(R.kept_mean(R.kappa_iterated(stack(spark, d), K, 1.9, 1.6), K))


@query(_with(WINS.format(lo=0.05, hi=0.95, least=3)) + " SELECT pixel, round(avg(wins), 6) AS value, count(wins) AS n FROM c GROUP BY pixel")
def winsor_quantile_mean(spark, d):
    s = R.winsorized(stack(spark, d), K, 0.05, 0.05, least=3)
    return rounded(s.groupBy("pixel").agg(F.avg("wins").alias("value"), F.count("wins").alias("n")))


@query(
    _with("o AS (SELECT pixel, list_sort(list(value)) AS a, count(*) AS n FROM s GROUP BY pixel)", "b AS (SELECT pixel, a[CAST(round_even(0.1 * (n - 1), 0) AS INT) + 1] AS lo, a[CAST(round_even(0.9 * (n - 1), 0) AS INT) + 1] AS hi FROM o)")
    + " SELECT pixel, round(avg(greatest(least(value, hi), lo)), 6) AS value, count(*) AS n FROM s JOIN b USING (pixel) GROUP BY pixel"
)
def winsor_order_stat(spark, d):
    s = R.winsorized(stack(spark, d), K, 0.1, 0.1, order_stat=True)
    return rounded(s.groupBy("pixel").agg(F.avg("wins").alias("value"), F.count("wins").alias("n")))


@query(_clip_sql(WINS.format(lo=0.05, hi=0.95, least=3) + ", " + _clipped("wins", 5, "c"), 1.8, 1.8))
def winsor_legacy_clip(spark, d):
    return rounded(R.winsor_clip(stack(spark, d), K, (0.05, 0.05), 1.8, 1.8, refill=False))


REFILL = """ SELECT pixel, round(sum((CASE WHEN kept THEN value ELSE wins END) * weight) / sum(weight), 6) AS value, count(*) FILTER (kept) AS kept,
 round(100.0 * (count(*) - count(*) FILTER (kept)) / count(*), 6) AS rejected_pct FROM k GROUP BY pixel"""


@query(_clip_sql(WINS.format(lo=0.1, hi=0.9, least=3) + ", z AS (SELECT *, median(wins) OVER w AS m, stddev_pop(wins) OVER w AS sd FROM c WINDOW w AS (PARTITION BY pixel))", 1.5, 1.5, REFILL))
def winsor_rewinsor(spark, d):
    return rounded(R.winsor_clip(stack(spark, d), K, (0.1, 0.1), 1.5, 1.5, refill=True, rounds=0))


def _huber_sql(low: float, high: float, rounds: int = 10) -> str:
    c, parts = max(low, high), [STACK_SQL]
    parts.append("h0 AS (SELECT pixel, any_value(m) AS m, CASE WHEN median(abs(value - m)) > 0 THEN 1.4826 * median(abs(value - m)) ELSE 1e-10 END AS sg, false AS done, 0 AS used FROM (SELECT *, median(value) OVER (PARTITION BY pixel) AS m FROM s) GROUP BY pixel)")
    for k in range(rounds):
        clamp = f"least(greatest(value, h.m - {low} * h.sg), h.m + {high} * h.sg)"
        parts.append(f"a{k} AS (SELECT s.pixel, sum({clamp} * weight) / sum(weight) AS mn FROM s JOIN h{k} h USING (pixel) GROUP BY s.pixel)")
        parts.append(
            f"b{k} AS (SELECT pixel, any_value(mn) AS mn, sqrt(sum(wt * r * r) / sum(wt)) AS sn FROM (SELECT pixel, mn, r, weight * CASE WHEN abs(r) / sg > {c} THEN {c} / (abs(r) / sg) ELSE 1.0 END AS wt"
            f" FROM (SELECT s.pixel, weight, h.sg, a.mn, {clamp} - a.mn AS r FROM s JOIN h{k} h USING (pixel) JOIN a{k} a USING (pixel))) GROUP BY pixel)"
        )
        sn = "CASE WHEN b.sn > 0 THEN b.sn ELSE 1e-10 END"
        parts.append(
            f"h{k + 1} AS (SELECT h.pixel, CASE WHEN h.done THEN h.m ELSE b.mn END AS m, CASE WHEN h.done THEN h.sg ELSE {sn} END AS sg,"
            f" h.done OR (abs(b.mn - h.m) <= 5e-4 * greatest(1.0, abs(h.m)) AND abs({sn} - h.sg) <= 5e-4 * greatest(1.0, abs(h.sg))) AS done, h.used + (NOT h.done)::INT AS used FROM h{k} h JOIN b{k} b USING (pixel))"
        )
    return "WITH " + ", ".join(parts) + (
        f" SELECT s.pixel, round(CASE WHEN count(*) >= 2 THEN any_value(h.m) ELSE avg(value) END, 6) AS value, round(any_value(h.sg), 6) AS sigma, count(*) AS n, any_value(h.used) AS rounds,"
        f" count(*) FILTER (value < h.m - {low} * h.sg) AS clipped_low, count(*) FILTER (value > h.m + {high} * h.sg) AS clipped_high FROM s JOIN h{rounds} h USING (pixel) GROUP BY s.pixel"
    )


@query(f"SELECT pixel, value FROM ({_huber_sql(1.5, 1.5)})")
def wsc_huber(spark, d):
    return rounded(R.huber_winsorized(stack(spark, d), K, 1.5, 1.5)).select("pixel", "value")


@query(_huber_sql(2.0, 1.5).replace("pixel", "channel").replace("l_partkey AS channel, ", "", 1))
def wsc_bounded(spark, d):
    """The same location of a few hot keys, of which no task holds the samples."""
    return rounded(R.huber_bounded(stack(spark, d, "channel"), ["channel"], 2.0, 1.5))


@query(f"SELECT sum(clipped_low)::BIGINT AS clipped_low, sum(clipped_high)::BIGINT AS clipped_high, sum(n)::BIGINT AS valid, max(rounds) AS rounds, round(100.0 * sum(clipped_low + clipped_high) / sum(n), 6) AS rejected_pct FROM ({_huber_sql(2.0, 1.5)})")
def wsc_stats(spark, d):
    f = R.huber_winsorized(stack(spark, d), K, 2.0, 1.5)
    return f.agg(F.sum("clipped_low").alias("clipped_low"), F.sum("clipped_high").alias("clipped_high"), F.sum("n").alias("valid"), F.max("rounds").alias("rounds"), F.round(100.0 * F.sum(F.col("clipped_low") + F.col("clipped_high")) / F.sum("n"), 6).alias("rejected_pct"))


@query(
    _with(
        "a AS (SELECT *, value - median(value) OVER (PARTITION BY pixel) AS r FROM s)",
        "k AS (SELECT *, abs(r - rm) <= 1.5 * rs AS kept FROM (SELECT *, median(r) OVER (PARTITION BY pixel) AS rm, stddev_pop(r) OVER (PARTITION BY pixel) AS rs FROM a))",
    )
    + KEPT
)
def linear_residual_clip(spark, d):
    return rounded(R.linear_residual_clip(stack(spark, d), K, 1.5))


@query(_with() + " SELECT pixel, round(CASE WHEN sum(weight) > 1e-6 THEN sum(value * weight) / sum(weight) ELSE 0 END, 6) AS value, round(sum(weight), 6) AS coverage FROM s GROUP BY pixel")
def coadd_mean(spark, d):
    return rounded(R.coadd_mean(stack(spark, d), K))


@query(_with(WINS.format(lo=0.05, hi=0.9, least=1)) + " SELECT pixel, round(sum(wins * weight) / greatest(sum(weight), 1e-6), 6) AS value FROM c GROUP BY pixel")
def coadd_winsor(spark, d):
    return rounded(R.coadd_winsor(stack(spark, d), K, (0.05, 0.1)))


@query(
    _with(
        "a AS (SELECT pixel, sum(weight) AS sw, sum(weight * value) AS sx, sum(weight * value * value) AS sxx, count(*) AS cnt FROM s GROUP BY pixel)",
        "b AS (SELECT pixel, sx / greatest(sw, 1e-6) AS m, sqrt(greatest(sxx / greatest(sw, 1e-6) - (sx / greatest(sw, 1e-6)) * (sx / greatest(sw, 1e-6)), 0)) AS sd, cnt FROM a)",
        "f AS (SELECT greatest(quantile_cont(sd, 0.05), 1e-4) AS fl FROM b)",
        "k AS (SELECT s.*, m, (cnt <= 1.5 OR abs(value - m) <= 1.5 * greatest(sd, fl)) AS kept FROM s JOIN b USING (pixel), f)",
    )
    + " SELECT pixel, round(CASE WHEN sum(CASE WHEN kept THEN weight ELSE 0 END) > 0 THEN sum(CASE WHEN kept THEN value * weight ELSE 0 END) / greatest(sum(CASE WHEN kept THEN weight ELSE 0 END), 1e-6) ELSE any_value(m) END, 6) AS value, round(sum(CASE WHEN kept THEN weight ELSE 0 END), 6) AS weight FROM k GROUP BY pixel"
)
def coadd_kappa_twopass(spark, d):
    return rounded(R.coadd_kappa(stack(spark, d), K, 1.5))


@query(_with(_clipped("value", 3, "s")) + " SELECT pixel, round(any_value(m), 6) AS value FROM z GROUP BY pixel")
def sigma_clipped_median(spark, d):
    return rounded(R.clipped_stats(stack(spark, d), K, 3.0, 3).groupBy("pixel").agg(F.first("m").alias("value")))


@query(
    _with("z AS (SELECT *, median(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM s WINDOW w AS (PARTITION BY pixel, channel))")
    + " SELECT channel, count(*) AS total, count(*) FILTER (abs(value - m) > 1.5 * sd) AS rejected, round(100.0 * count(*) FILTER (abs(value - m) > 1.5 * sd) / count(*), 6) AS rejected_pct FROM z GROUP BY channel"
)
def rejected_pct(spark, d):
    s = R.clip_once(stack(spark, d, "channel"), ["pixel", "channel"], 1.5, 1.5)
    lost = F.count(F.when(~F.col("kept"), 1))
    return rounded(s.groupBy("channel").agg(F.count("value").alias("total"), lost.alias("rejected"), (100.0 * lost / F.count("value")).alias("rejected_pct")))


@query(_with("p AS (SELECT pixel, frame % 4 AS part, avg(value) AS mean, sum(weight) AS w FROM s GROUP BY ALL)") + " SELECT pixel, round(sum(mean * w) / greatest(sum(w), 1e-6), 6) AS value, round(sum(w), 6) AS weight, count(*) AS parts FROM p GROUP BY pixel")
def stream_partial_final(spark, d):
    return rounded(R.partial_final(stack(spark, d, "frame"), K, F.col("frame") % 4))


@query(
    _with("b AS (SELECT frame, channel, median(value) AS bg FROM s GROUP BY ALL)", "t AS (SELECT channel, median(bg) AS target FROM b GROUP BY channel)")
    + " SELECT frame, channel, round(bg, 6) AS background, round(bg - target, 6) AS delta FROM b JOIN t USING (channel)"
)
def background_harmonize(spark, d):
    tile = stack(spark, d, "frame", "channel").groupBy("frame", "channel").agg(F.median("value").alias("background"))
    target = tile.groupBy("channel").agg(F.median("background").alias("target"))
    return rounded(tile.join(target, "channel").select("frame", "channel", "background", (F.col("background") - F.col("target")).alias("delta")))


@query(_with("c AS (SELECT channel, median(value) AS med FROM s GROUP BY channel)") + " SELECT s.pixel, s.channel, round(avg(s.value - c.med), 6) AS value FROM s JOIN c USING (channel) GROUP BY ALL")
def background_normalize(spark, d):
    s = stack(spark, d, "channel")
    c = F.broadcast(quantiles(s, ["channel"], "value", {"med": 0.5}))  # one row a channel
    return rounded(s.join(c, "channel").groupBy("pixel", "channel").agg(F.avg(F.col("value") - F.col("med")).alias("value")))


@query(_with() + " SELECT channel, round(min(value), 6) AS low, round(median(value), 6) AS median, round(max(value), 6) AS high, count(*) AS n FROM s GROUP BY channel")
def channel_stats(spark, d):
    s = stack(spark, d, "channel")
    told = s.groupBy("channel").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n"))
    return rounded(beside(told, s, ["channel"], "value", {"median": 0.5}))


@query(
    _with(
        "p AS (SELECT pixel, avg(value) FILTER (channel = 'R') AS r, avg(value) FILTER (channel = 'N') AS g, avg(value) FILTER (channel = 'A') AS b FROM s GROUP BY pixel)",
        "v AS (SELECT *, (r + g + b) / 3 AS l FROM p WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL)",
        "q AS (SELECT quantile_cont(l, 0.05) AS lo, quantile_cont(l, 0.85) AS hi FROM v)",
        "m AS (SELECT median(r) AS r, median(g) AS g, median(b) AS b, count(*) AS n FROM v, q WHERE l BETWEEN lo AND hi)",
        "t AS (SELECT *, (r + g + b) / 3 AS target FROM m)",
    )
    + " SELECT round(least(greatest(target / r, 0.95), 1.05), 6) AS gain_r, round(least(greatest(target / g, 0.95), 1.05), 6) AS gain_g, round(least(greatest(target / b, 0.95), 1.05), 6) AS gain_b, n FROM t"
)
def rgb_equalize(spark, d):
    c = F.col("channel")
    mean = lambda k: F.avg(F.when(c == k, F.col("value")))
    p = stack(spark, d, "channel").groupBy("pixel").agg(mean("R").alias("r"), mean("N").alias("g"), mean("A").alias("b")).dropna()
    p = p.withColumn("l", (F.col("r") + F.col("g") + F.col("b")) / 3)
    q = F.broadcast(p.agg(F.percentile("l", F.lit(0.05)).alias("lo"), F.percentile("l", F.lit(0.85)).alias("hi")))  # one row
    m = p.crossJoin(q).where("l BETWEEN lo AND hi").agg(*[F.median(k).alias(k) for k in "rgb"], F.count(F.lit(1)).alias("n"))
    target = (F.col("r") + F.col("g") + F.col("b")) / 3
    return rounded(m.select(*[F.least(F.greatest(target / F.col(k), F.lit(0.95)), F.lit(1.05)).alias(f"gain_{k}") for k in "rgb"], "n"))


@query(_with("c AS (SELECT pixel // 16 AS cell_y, frame // 4 AS cell_x, value FROM s)") + " SELECT cell_y, cell_x, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance, count(*) AS n FROM c GROUP BY ALL")
def block_pool(spark, d):
    s = stack(spark, d, "frame").select(F.floor(F.col("pixel") / 16).alias("cell_y"), F.floor(F.col("frame") / 4).alias("cell_x"), "value")
    return rounded(s.groupBy("cell_y", "cell_x").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.count("value").alias("n")))


@query(_with() + " SELECT channel, min(pixel) AS y0, max(pixel) + 1 AS y1, min(frame) AS x0, max(frame) + 1 AS x1 FROM s WHERE value > 250 GROUP BY channel")
def bbox_of_mask(spark, d):
    s = stack(spark, d, "frame", "channel").where("value > 250")
    return s.groupBy("channel").agg(F.min("pixel").alias("y0"), (F.max("pixel") + 1).alias("y1"), F.min("frame").alias("x0"), (F.max("frame") + 1).alias("x1"))
