"""Robust N-way combination: one value from the weighted samples of each key.

Every function takes a relation with the key columns, ``value`` and ``weight`` (NULL is missing) and works in one
shuffle by the key: statistics are windows over the key's rows, and the final aggregation keeps that distribution.
A key without valid samples gives NULL unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.columns import finite, safe_div
from lumenfold.operators.selection import quantiles
from lumenfold.session import materialize


def samples(df: DataFrame, keys: dict[str, Column], value: Column, weight: Column | None = None) -> DataFrame:
    """The common form; non-finite values are missing, non-finite weights are 0."""
    w = F.lit(1.0) if weight is None else F.coalesce(finite(weight), F.lit(0.0))
    return df.select(*[c.alias(k) for k, c in keys.items()], finite(value).alias("value"), w.alias("weight"))


def _over(keys: list[str]):
    return Window.partitionBy(*keys)


def weighted(value: Column, weight: Column, when: Column | None = None) -> Column:
    """Weighted mean, or the plain one where no weight is positive."""
    v = value if when is None else F.when(when, value)
    w = F.when(v.isNotNull(), weight)
    return F.coalesce(safe_div(F.sum(v * w), F.when(F.sum(w) > 0, F.sum(w))), F.avg(v))


def combine(s: DataFrame, keys: list[str], method: str = "mean") -> DataFrame:
    v = F.col("value")
    how = {"mean": F.avg(v), "median": F.median(v), "min": F.min(v), "max": F.max(v), "weighted": weighted(v, F.col("weight"))}
    return s.groupBy(*keys).agg(how.get(method, how["mean"]).alias("value"), F.count(v).alias("n"))


def kept_mean(s: DataFrame, keys: list[str], *, fallback: bool = True) -> DataFrame:
    """Of rows with ``kept``: the weighted mean, the plain mean if all were rejected, and the rejected percentage."""
    v, k = F.col("value"), F.col("kept")
    total = F.count(v)
    kept = F.count(F.when(k, v))
    mean = weighted(v, F.col("weight"), k)
    return s.groupBy(*keys).agg((F.coalesce(mean, F.avg(v)) if fallback else mean).alias("value"), kept.alias("kept"), (100.0 * (total - kept) / F.when(total > 0, total)).alias("rejected_pct"))


def clip_once(s: DataFrame, keys: list[str], low: float, high: float, center: str = "median") -> DataFrame:
    """kept: within center - low * sigma .. center + high * sigma of the key's samples, both ends in."""
    w, v = _over(keys), F.col("value")
    m = (F.median(v) if center == "median" else F.avg(v)).over(w)
    sd = F.stddev_pop(v).over(w)
    marked = s.withColumn("m", m).withColumn("sd", sd)
    return marked.withColumn("kept", (v >= F.col("m") - low * F.col("sd")) & (v <= F.col("m") + high * F.col("sd"))).drop("m", "sd")


def clipped_stats(s: DataFrame, keys: list[str], sigma: float, rounds: int, source: str = "value") -> DataFrame:
    """Adds m, sd: median and deviation after so many rounds of clipping about the median."""
    w = _over(keys)
    s = s.withColumn("_in", F.col(source))
    for _ in range(rounds):
        s = s.withColumn("_m", F.median("_in").over(w)).withColumn("_s", F.stddev_pop("_in").over(w))
        s = s.withColumn("_in", F.when(F.abs(F.col("_in") - F.col("_m")) <= sigma * F.col("_s"), F.col("_in")))
    return s.withColumn("m", F.median("_in").over(w)).withColumn("sd", F.stddev_pop("_in").over(w)).drop("_in", "_m", "_s")


def kappa_iterated(s: DataFrame, keys: list[str], low: float = 3.0, high: float = 3.0, rounds: int = 5) -> DataFrame:
    v = F.col("value")
    marked = clipped_stats(s, keys, 3.0, rounds)
    return marked.withColumn("kept", (v >= F.col("m") - low * F.col("sd")) & (v <= F.col("m") + high * F.col("sd")))


def winsorized(s: DataFrame, keys: list[str], low: float, high: float, least: int = 1, order_stat: bool = False) -> DataFrame:
    """Adds ``wins``: the value clamped to the key's quantiles (interpolated, or rounded order statistics)."""
    w, v = _over(keys), F.col("value")
    n = F.count(v).over(w)
    if order_stat:
        ordered = F.array_sort(F.collect_list(v).over(w))
        at = lambda q: F.element_at(ordered, (F.bround(F.lit(q) * (n - 1)) + 1).cast("int"))
        s = s.withColumn("_n", n).withColumn("_lo", F.when(n > 0, at(low))).withColumn("_hi", F.when(n > 0, at(1 - high)))
    else:
        s = s.withColumn("_n", n).withColumn("_lo", F.percentile(v, F.lit(low)).over(w)).withColumn("_hi", F.percentile(v, F.lit(1 - high)).over(w))
    clamped = F.when(v.isNotNull(), F.greatest(F.least(v, F.col("_hi")), F.col("_lo")))
    return s.withColumn("wins", F.when(F.col("_n") >= least, clamped).otherwise(v)).drop("_n", "_lo", "_hi")


def winsor_clip(s: DataFrame, keys: list[str], limits: tuple[float, float], low: float, high: float, *, refill: bool, rounds: int = 5) -> DataFrame:
    """Statistics of the clamped samples (clipped so many rounds; 0: as they are) reject originals; a rejected sample
    is dropped, or with ``refill`` replaced by its clamped value."""
    v = F.col("value")
    clamped = winsorized(s, keys, *limits, least=3)
    if rounds:
        marked = clipped_stats(clamped, keys, 3.0, rounds, "wins")
    else:
        w = _over(keys)
        marked = clamped.withColumn("m", F.median("wins").over(w)).withColumn("sd", F.stddev_pop("wins").over(w))
    marked = marked.withColumn("kept", (v >= F.col("m") - low * F.col("sd")) & (v <= F.col("m") + high * F.col("sd")))
    if not refill:
        return kept_mean(marked, keys)
    total, kept = F.count(v), F.count(F.when(F.col("kept"), v))
    filled = F.when(F.col("kept"), v).otherwise(F.col("wins"))
    return marked.groupBy(*keys).agg(weighted(filled, F.col("weight")).alias("value"), kept.alias("kept"), (100.0 * (total - kept) / F.when(total > 0, total)).alias("rejected_pct"))


def linear_residual_clip(s: DataFrame, keys: list[str], sigma: float) -> DataFrame:
    """Residuals about the median, rejected beyond ``sigma`` of their own deviation about their own median."""
    w = _over(keys)
    r = s.withColumn("r", F.col("value") - F.median("value").over(w))
    r = r.withColumn("rm", F.median("r").over(w)).withColumn("rs", F.stddev_pop("r").over(w))
    return kept_mean(r.withColumn("kept", F.abs(F.col("r") - F.col("rm")) <= sigma * F.col("rs")), keys)


def huber_winsorized(s: DataFrame, keys: list[str], low: float, high: float, *, rounds: int = 10, huber: float | None = None, tolerance: float = 5e-4) -> DataFrame:
    """Huber-weighted winsorised location: starts at median and 1.4826 MAD; each round clamps to
    m - low * s .. m + high * s and takes the weighted mean and Huber-weighted deviation, until neither moves by more
    than the tolerance. Each key stops by itself. One aggregation to an array, then expressions alone; the array
    is sorted so that sums have one order. Fewer than two samples give their mean."""
    c = max(low, high) if huber is None else huber
    w = _over(keys)
    v = F.col("value")
    start = s.withColumn("_m", F.median(v).over(w))
    start = start.withColumn("_d", F.median(F.abs(v - F.col("_m"))).over(w))
    packed = start.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(v.alias("v"), F.col("weight").alias("w"))))).alias("x"),
        F.first("_m").alias("m0"), (F.first("_d") * 1.4826).alias("s0"), F.avg(v).alias("mean"), F.count(v).alias("n"),
    )
    x = F.col("x")
    floor = lambda e: F.when(e > 0, e).otherwise(1e-10)
    state = lambda m, sd, done, used: F.struct(m.alias("m"), sd.alias("s"), done.alias("done"), used.alias("used"))

    bound = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  binds a value, so that it is computed once
    pair = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    none = pair(F.lit(0.0), F.lit(0.0))

    def step(a: Column, _) -> Column:
        def clamped(q: Column) -> Column:
            return F.transform(x, lambda e: F.struct(F.least(F.greatest(e["v"], q["p"]), q["q"]).alias("v"), e["w"].alias("w")))

        def located(y: Column) -> Column:
            sums = F.aggregate(y, none, lambda t, e: pair(t["p"] + e["v"] * e["w"], t["q"] + e["w"]), lambda t: safe_div(t["p"], t["q"]))
            return bound(sums, lambda mean: deviation(y, mean))

        def deviation(y: Column, mean: Column) -> Column:
            # u is how many deviations an element lies off, wt its Huber weight
            far = F.transform(y, lambda e: F.struct((e["v"] - mean).alias("d"), (F.abs(e["v"] - mean) / a["s"]).alias("u"), e["w"].alias("w")))
            far = F.transform(far, lambda e: F.struct(e["d"].alias("d"), (e["w"] * F.when(e["u"] > c, c / e["u"]).otherwise(1.0)).alias("w")))
            spread = F.aggregate(far, none, lambda t, e: pair(t["p"] + e["w"] * e["d"] * e["d"], t["q"] + e["w"]), lambda t: safe_div(t["p"], t["q"]))
            return bound(floor(F.sqrt(F.coalesce(spread, F.lit(0.0)))), lambda sd: judged(mean, sd))

        def judged(m: Column, sd: Column) -> Column:
            near = lambda new, old: F.abs(new - old) <= tolerance * F.greatest(F.lit(1.0), F.abs(old))
            return state(m, sd, near(m, a["m"]) & near(sd, a["s"]), a["used"] + 1)

        return F.when(a["done"], a).otherwise(bound(pair(a["m"] - low * a["s"], a["m"] + high * a["s"]), lambda q: bound(clamped(q), located)))

    begin = state(F.col("m0"), floor(F.col("s0")), F.lit(False), F.lit(0))
    fit = packed.withColumn("fit", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, step))
    m, sd = F.col("fit.m"), F.col("fit.s")
    return fit.select(
        *keys, F.when(F.col("n") >= 2, m).otherwise(F.col("mean")).alias("value"), sd.alias("sigma"), F.col("n"), F.col("fit.used").alias("rounds"),
        F.size(F.filter(x, lambda e: e["v"] < m - low * sd)).cast("long").alias("clipped_low"), F.size(F.filter(x, lambda e: e["v"] > m + high * sd)).cast("long").alias("clipped_high"),
    )


def coadd_mean(s: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of weighted values over sum of weights, 0 where the weights vanish; coverage is that sum."""
    w = F.when(F.col("value").isNotNull(), F.col("weight"))
    return s.groupBy(*keys).agg(F.when(F.sum(w) > 1e-6, F.sum(F.col("value") * w) / F.sum(w)).otherwise(0.0).alias("value"), F.coalesce(F.sum(w), F.lit(0.0)).alias("coverage"))


def coadd_winsor(s: DataFrame, keys: list[str], limits: tuple[float, float]) -> DataFrame:
    w = F.when(F.col("value").isNotNull(), F.col("weight"))
    return winsorized(s, keys, *limits).groupBy(*keys).agg((F.sum(F.col("wins") * w) / F.greatest(F.sum(w), F.lit(1e-6))).alias("value"))


def coadd_kappa(s: DataFrame, keys: list[str], kappa: float) -> DataFrame:
    """Weighted mean and variance from three sums; the deviations' 5th percentile (at least 1e-4) is their floor; then
    one clip about the mean. Keys of one sample keep it."""
    w = F.when(F.col("value").isNotNull(), F.col("weight"))
    sums = s.groupBy(*keys).agg(F.sum(w).alias("sw"), F.sum(w * F.col("value")).alias("sx"), F.sum(w * F.col("value") * F.col("value")).alias("sxx"), F.count("value").alias("cnt"))
    mean = F.col("sx") / F.greatest(F.col("sw"), F.lit(1e-6))
    ref = sums.select(*keys, mean.alias("m"), F.sqrt(F.greatest(F.col("sxx") / F.greatest(F.col("sw"), F.lit(1e-6)) - mean * mean, F.lit(0.0))).alias("sd"), "cnt")
    floor = ref.agg(F.greatest(F.percentile("sd", F.lit(0.05)), F.lit(1e-4)).alias("floor"))
    joined = s.join(ref, keys).crossJoin(F.broadcast(floor))  # one row
    kept = (F.col("cnt") <= 1.5) | (F.abs(F.col("value") - F.col("m")) <= kappa * F.greatest(F.col("sd"), F.col("floor")))
    kw = F.when(kept & F.col("value").isNotNull(), F.col("weight")).otherwise(0.0)
    value = F.when(F.sum(kw) > 0, F.sum(F.coalesce(F.col("value"), F.lit(0.0)) * kw) / F.greatest(F.sum(kw), F.lit(1e-6))).otherwise(F.first("m"))
    return joined.groupBy(*keys).agg(F.coalesce(value, F.lit(0.0)).alias("value"), F.sum(kw).alias("weight"))


def partial_final(s: DataFrame, keys: list[str], part: Column) -> DataFrame:
    """Mergeable sums by part, then the whole: what a stream's passes add up to."""
    parts = s.withColumn("part", part).groupBy(*keys, "part").agg(F.avg("value").alias("mean"), F.sum(F.when(F.col("value").isNotNull(), F.col("weight"))).alias("w"))
    return parts.groupBy(*keys).agg((F.sum(F.col("mean") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-6))).alias("value"), F.sum("w").alias("weight"), F.count(F.lit(1)).alias("parts"))


def huber_bounded(s: DataFrame, keys: list[str], low: float, high: float, *, rounds: int = 10, huber: float | None = None, tolerance: float = 5e-4) -> DataFrame:
    """As ``huber_winsorized``, for keys of any number of samples: start values by selection, then rounds of partial sums that are
    joined back, so that no task holds a key's samples. A round is two aggregations over the keys that still move."""
    c = max(low, high) if huber is None else huber
    rows = materialize(s.where(F.col("value").isNotNull()).select(*keys, "value", F.col("weight").alias("w")), "samples")
    m = quantiles(rows, keys, "value", {"m": 0.5})
    floor = lambda e: F.when(e > 0, e).otherwise(1e-10)
    off = quantiles(rows.join(m, keys).withColumn("off", F.abs(F.col("value") - F.col("m"))), keys, "off", {"d": 0.5})
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    state = m.join(off, keys).join(sizes, keys).select(*keys, "n", "mean", "m", floor(F.col("d") * 1.4826).alias("s"), F.lit(False).alias("done"), F.lit(0).alias("used"))
    state = materialize(state, "locations")
    v = F.least(F.greatest("value", F.col("m") - low * F.col("s")), F.col("m") + high * F.col("s"))
    for _ in range(rounds):
        moving = state.where("not done").select(*keys, "m", "s")
        held = rows.join(moving, keys)
        mean = held.groupBy(*keys).agg(safe_div(F.sum(v * F.col("w")), F.sum("w")).alias("m1"))
        far = held.join(mean, keys).withColumn("d", v - F.col("m1")).withColumn("u", F.abs("d") / F.col("s"))
        far = far.withColumn("h", F.col("w") * F.when(F.col("u") > c, c / F.col("u")).otherwise(1.0))
        new = far.groupBy(*keys).agg(F.first("m1").alias("m1"), floor(F.sqrt(F.coalesce(safe_div(F.sum(F.col("h") * F.col("d") * F.col("d")), F.sum("h")), F.lit(0.0)))).alias("s1"))
        j = state.join(new, keys, "left")
        near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= tolerance * F.greatest(F.lit(1.0), F.abs(F.col(b)))
        pick = lambda a, b: F.when(F.col("done") | F.col("s1").isNull(), F.col(b)).otherwise(F.col(a)).alias(b)
        still = near("m1", "m") & near("s1", "s")
        state = materialize(j.select(*keys, "n", "mean", pick("m1", "m"), pick("s1", "s"), (F.col("done") | F.coalesce(still, F.lit(True))).alias("done"), (F.col("used") + (~F.col("done")).cast("int")).alias("used")), "locations")
        if state.where("not done").isEmpty():
            break
    cut = rows.join(state.select(*keys, "m", "s"), keys).groupBy(*keys).agg(F.count(F.when(F.col("value") < F.col("m") - low * F.col("s"), 1)).alias("clipped_low"), F.count(F.when(F.col("value") > F.col("m") + high * F.col("s"), 1)).alias("clipped_high"))
    return state.join(cut, keys).select(*keys, F.when(F.col("n") >= 2, F.col("m")).otherwise(F.col("mean")).alias("value"), F.col("s").alias("sigma"), "n", F.col("used").alias("rounds"), "clipped_low", "clipped_high")
