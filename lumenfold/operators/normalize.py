"""Normalisation of frames against a reference, weights of frames, and robust regression between frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.columns import clamp, safe_div
from lumenfold.operators.robust import clipped_stats
from lumenfold.session import materialize


#: Keys whose fits are told by broadcast (some 200 bytes each); by shuffle beyond.
BROADCAST_KEYS = 200_000


def told(fits: DataFrame) -> DataFrame:
    """``fits`` by broadcast where they are few, so that their samples stay where they are."""
    return F.broadcast(fits) if fits.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else fits


def linear_fit(stats: DataFrame, ref: DataFrame, keys: list[str], *, max_gain: float = 10.0) -> DataFrame:
    """a, b that carry each frame's (low, high) percentiles to the reference's; neutral where they say nothing."""
    j = stats.join(ref, keys) if keys else stats.crossJoin(F.broadcast(ref))
    ds, dr = F.col("high") - F.col("low"), F.col("ref_high") - F.col("ref_low")
    least = F.greatest(F.lit(1e-3), 1e-3 * F.greatest(F.abs("low"), F.abs("high"), F.lit(1.0)))
    a = F.when(F.abs(ds) < least, 1.0).when(F.abs(dr) > 1e-5, safe_div(dr, ds)).otherwise(1.0)
    b = F.when(F.abs(ds) < least, 0.0).otherwise(F.col("ref_low") - F.col("a0") * F.col("low"))
    j = j.withColumn("a0", a).withColumn("b0", b)
    sane = F.abs("a0") <= max_gain
    return j.withColumn("a", F.when(sane, F.col("a0")).otherwise(1.0)).withColumn("b", F.when(sane, F.col("b0")).otherwise(0.0)).drop("a0", "b0")


def inverse_variance(s: DataFrame, keys: list[str]) -> DataFrame:
    """weight = least variance / variance, of clipped samples; frames without a variance get 1e-6."""
    var = clipped_stats(s, keys, 3.0, 5).groupBy(*keys).agg((F.first("sd") * F.first("sd")).alias("variance"))
    good = F.when(F.col("variance") > 0, F.col("variance"))
    least = var.agg(F.min(good).alias("least"))
    return var.crossJoin(F.broadcast(least)).select(*keys, "variance", F.coalesce(F.col("least") / good, F.lit(1e-6)).alias("weight"))


def radial_weight(y: Column, x: Column, height: int, width: int, *, feather: float = 0.9, power: float = 2.0, floor: float = 0.05) -> Column:
    cy, cx = (height - 1) / 2, (width - 1) / 2
    r = F.sqrt((y - cy) * (y - cy) + (x - cx) * (x - cx)) / (math.hypot(height, width) / 2 * feather)
    return F.greatest(F.pow(F.cos(clamp(r, 0.0, 1.0) * (math.pi / 2)), power), F.lit(floor))


def ols(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y", kept: Column | None = None) -> DataFrame:
    """slope, intercept, n over the rows of each key; moments alone, so partial sums merge."""
    k = F.lit(True) if kept is None else kept
    xx, yy = F.when(k, F.col(x)), F.when(k, F.col(y))
    return pairs.groupBy(*keys).agg(safe_div(F.covar_pop(xx, yy), F.var_pop(xx)).alias("slope"), F.avg(xx).alias("mx"), F.avg(yy).alias("my"), F.count(xx).alias("n")).select(
        *keys, "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "n"
    )


def trimmed_regression(pairs: DataFrame, keys: list[str], *, sigma: float = 3.0, least: int = 16) -> DataFrame:
    """One fit, one trim of residuals at ``sigma`` deviations, one more fit; neutral below ``least`` samples."""
    return iterated_regression(pairs, keys, sigma=sigma, rounds=1, least=least, stop=least)


def iterated_regression(pairs: DataFrame, keys: list[str], *, sigma: float = 2.5, rounds: int = 6, least: int = 16, stop: int = 8) -> DataFrame:
    """Fit and clip by residual deviation, so many rounds; a key stops when a clip would leave fewer than ``stop`` samples or its
    deviation is at most 1e-6. A key's fits and bounds so far are one small row, joined to its samples, so a round is two
    aggregations of partial sums, and a key of any size is spread over tasks."""
    rows = materialize(pairs.select(*keys, "x", "y"), "regression")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()

    def moments(kept: Column) -> list[Column]:
        xx, yy = F.when(kept, F.col("x")), F.when(kept, F.col("y"))
        return [safe_div(F.covar_pop(xx, yy), F.var_pop(xx)).alias("slope"), F.avg(xx).alias("mx"), F.avg(yy).alias("my"), F.count(xx).alias("n")]

    line = (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept")
    none = F.lit(None).cast("array<struct<slope:double,intercept:double,most:double>>")
    state = rows.groupBy(*keys).agg(*moments(both)).select(*keys, "slope", line, "n", F.col("n").alias("total"), (F.col("n") < least).alias("stopped"), F.coalesce(none, F.array()).alias("cuts"))
    state = materialize(state, "fits")
    within = lambda c: F.abs(F.col("y") - c["slope"] * F.col("x") - c["intercept"]) <= c["most"]
    for turn in range(rounds):
        if turn and state.where("not stopped").isEmpty():
            break
        open_ = state.where("not stopped").select(*keys, "slope", "intercept", "cuts")
        held = rows.where(both).join(told(open_), keys).where(F.forall("cuts", within))
        spread = held.groupBy(*keys).agg(F.stddev_pop(F.col("y") - F.col("slope") * F.col("x") - F.col("intercept")).alias("rs"))
        tried = materialize(open_.join(spread, keys).select(*keys, "rs", "cuts", F.struct("slope", "intercept", (sigma * F.col("rs")).alias("most")).alias("cut")), "tried")
        again = rows.where(both).join(told(tried), keys).where(F.forall("cuts", within) & within(F.col("cut")))
        new = again.groupBy(*keys).agg(*moments(F.lit(True)), F.first("rs").alias("rs"), F.first("cut").alias("cut")).where((F.col("rs") > 1e-6) & (F.col("n") >= stop))
        new = new.select(*keys, F.col("slope").alias("n_slope"), (F.col("my") - F.col("slope") * F.col("mx")).alias("n_intercept"), F.col("n").alias("n_n"), "cut")
        j, goes = state.join(new, keys, "left"), F.col("n_n").isNotNull()
        pick = lambda c: F.when(goes, F.col("n_" + c)).otherwise(F.col(c)).alias(c)  # noqa: E731, B023
        state = materialize(j.select(*keys, pick("slope"), pick("intercept"), pick("n"), "total", (~goes).alias("stopped"), F.when(goes, F.array_append("cuts", F.col("cut"))).otherwise(F.col("cuts")).alias("cuts")), "fits")
    few = F.col("total") < least
    return state.select(*keys, F.when(few, 1.0).otherwise(F.coalesce("slope", F.lit(1.0))).alias("gain"), F.when(few, 0.0).otherwise(F.coalesce("intercept", F.lit(0.0))).alias("offset"), "n")
