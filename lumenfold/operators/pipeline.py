"""Whole stacks: normalise, weight, reject and combine by name, as the dispatchers of a stacking run do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators import normalize, robust

REJECT = {
    "none": lambda s, k, o: s.withColumn("kept", F.lit(True)),
    "kappa": lambda s, k, o: robust.clip_once(s, k, o["low"], o["high"]),
    "kappa_mean": lambda s, k, o: robust.clip_once(s, k, o["low"], o["high"], "mean"),
    "kappa_iterated": lambda s, k, o: robust.kappa_iterated(s, k, o["low"], o["high"]),
}


def normalized(s: DataFrame, keys: list[str], method: str) -> DataFrame:
    """Samples (keys, frame, value, weight) with frames brought to the first one: none, median, linear_fit or median_ratio."""
    if method == "median":
        return s.withColumn("value", F.col("value") - F.median("value").over(Window.partitionBy(*keys)))
    if method == "linear_fit":
        p = s.groupBy("frame").agg(F.percentile("value", F.lit(0.25)).alias("low"), F.percentile("value", F.lit(0.9)).alias("high"))
        ref = p.orderBy("frame").limit(1).select(F.col("low").alias("ref_low"), F.col("high").alias("ref_high"))
        fit = normalize.linear_fit(p, ref, []).select("frame", "a", "b")
        return s.join(fit, "frame").withColumn("value", F.col("a") * F.col("value") + F.col("b")).drop("a", "b")
    if method == "median_ratio":
        m = s.groupBy("frame").agg(F.median("value").alias("med"))
        ref = F.broadcast(m.orderBy("frame").limit(1).select(F.col("med").alias("ref")))
        g = m.crossJoin(ref).select("frame", F.when(F.col("med") != 0, F.col("ref") / F.col("med")).otherwise(1.0).alias("g"))
        return s.join(g, "frame").withColumn("value", F.col("value") * F.col("g")).drop("g")
    return s


def weighed(s: DataFrame, method: str) -> DataFrame:
    """Weights by frame: none keeps the samples' own, noise_variance multiplies by inverse variances."""
    if method != "noise_variance":
        return s
    w = normalize.inverse_variance(s, ["frame"]).select("frame", F.col("weight").alias("w_frame"))
    return s.join(w, "frame").withColumn("weight", F.col("weight") * F.col("w_frame")).drop("w_frame")


def stack(s: DataFrame, keys: list[str], *, normalization: str = "none", weighting: str = "none", rejection: str = "kappa", combine: str = "mean", low: float = 3.0, high: float = 3.0) -> DataFrame:
    if rejection not in {*REJECT, "winsor", "linear", "wsc"}:
        raise ValueError(f"unknown rejection {rejection}")
    if combine not in ("mean", "median"):
        raise ValueError(f"unknown combination {combine}")
    s = weighed(normalized(s, keys, normalization), weighting)
    if rejection == "wsc":
        return robust.huber_winsorized(s, keys, low, high).select(*keys, "value", F.col("n").alias("kept"), (100.0 * (F.col("clipped_low") + F.col("clipped_high")) / F.when(F.col("n") > 0, F.col("n"))).alias("rejected_pct"))
    if rejection == "winsor":
        return robust.winsor_clip(s, keys, (0.05, 0.05), low, high, refill=False)
    if rejection == "linear":
        return robust.linear_residual_clip(s, keys, low)
    marked = REJECT[rejection](s, keys, {"low": low, "high": high})
    if combine == "median":
        kept = F.when(F.col("kept"), F.col("value"))
        total = F.count("value")
        return marked.groupBy(*keys).agg(F.median(kept).alias("value"), F.count(kept).alias("kept"), (100.0 * (total - F.count(kept)) / F.when(total > 0, total)).alias("rejected_pct"))
    return robust.kept_mean(marked, keys)
