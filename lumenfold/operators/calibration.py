"""Calibration of overlapping tiles: from boxes and samples to a gain and an offset for each tile.

Overlaps are joined once; a ladder of thresholds is decided from counts of that one pass. Edges are pruned to each tile's
heaviest, bridges keep components together. A pair is fitted on the samples that both tiles have at a place, inside the
sky's band. A chain of solvers then ends at the first that gives a solution: gains and offsets, offsets alone, the
damped relaxation; without any overlap, medians.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import graph, normalize, overlaps, spatial
from lumenfold.operators.overlaps import STRETCH
from lumenfold.session import materialize, ship

# fixed values: they must equal those of the calibration that this one replaces
LADDER = (0.03, 0.02, 0.01)
LEAST_SAMPLES, LEAST_SKY = 64, 32
PAIR_GAIN, PAIR_OFFSET = (0.5, 2.0), 5000.0
GAIN, OFFSET = (0.9, 1.1), (-2000.0, 2000.0)
RIDGE = 0.02


@dataclass(frozen=True)
class Calibration:
    """solution (id, gain, offset), and what led to it; ``pairs`` (i, j, a, b, w, n, reason) are the constraints."""

    solution: DataFrame
    pairs: DataFrame | None
    status: str
    threshold: float | None
    raw: int
    kept: int
    anchor: int | None


def ladder(pairs: DataFrame, base: float, steps: tuple[float, ...] = LADDER, n: Column | None = None) -> DataFrame:
    """One row (threshold, pairs): the highest rung, from ``base`` down, that any pair's fraction reaches; none: nulls. A row
    stands for ``n`` pairs."""
    n = F.lit(1) if n is None else n
    rungs = list(dict.fromkeys([max(0.0, base), *[s for s in steps if s < base - 1e-6]]))
    counts = pairs.agg(*[F.sum(F.when(F.col("fraction") >= r, n)).cast("long").alias(f"n{k}") for k, r in enumerate(rungs)])
    first = F.coalesce(*[F.when(F.col(f"n{k}") > 0, F.struct(F.lit(r).cast("double").alias("threshold"), F.col(f"n{k}").alias("pairs"))) for k, r in enumerate(rungs)])
    return counts.select(first.alias("f")).select("f.threshold", "f.pairs")


def pruned(nodes: int, edges: int, k: int) -> bool:
    return k > 0 and nodes >= 10 and edges > 2 * nodes * k


def prune(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(i, j, w): each node's k heaviest edges and the bridges between what they hold together, where there are many."""
    if not pruned(nodes.count(), edges.count(), k):
        return edges
    kept = materialize(graph.top_edges(edges, k), "kept-edges")
    bridges = graph.bridges(nodes.select("id"), kept, edges)
    return kept.unionByName(bridges.join(edges, ["i", "j"]).select("i", "j", "w")).distinct()


def stretch() -> Column:
    return F.floor(F.col("place") / STRETCH)


def pair_samples(edges: DataFrame, samples: DataFrame) -> DataFrame:
    """(i, j, x, y): what both tiles of an edge have at a place; ``samples`` are (id, place, value), one each. A tile's samples
    travel as arrays of ``STRETCH`` places, and only where the other tile of an edge reaches into what it has of these; so an
    edge's samples are found, and stay, together. Samples that are dealt by (id, stretch) already aren't sent again."""
    ship(edges.sparkSession)
    fine = samples.where(F.col("value").isNotNull() & ~F.isnan("value"))
    fine = fine if "stretch" in samples.columns else fine.withColumn("stretch", stretch())
    held = fine.groupBy("id", "stretch").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.collect_list("place").alias("places"), F.collect_list("value").alias("values"))
    held = materialize(held, "stretches")
    ends = lambda t: held.select(F.col("id").alias(t), "stretch", F.col("first").alias(f"first_{t}"), F.col("last").alias(f"last_{t}"))
    met = edges.select("i", "j").join(ends("i"), "i").join(ends("j"), ["j", "stretch"]).where(F.greatest("first_i", "first_j") <= F.least("last_i", "last_j")).select("i", "j", "stretch")
    side = lambda t: held.select(F.col("id").alias(t), "stretch", F.col("places").alias(f"at_{t}"), F.col("values").alias(f"of_{t}"))
    both = met.join(side("i"), ["i", "stretch"]).join(side("j"), ["j", "stretch"]).select("i", "j", "at_i", "of_i", "at_j", "of_j")

    def matched(batches):
        for b in batches:
            i, j = (b.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            for r in range(b.num_rows):
                at_i, of_i, at_j, of_j = (b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in range(2, 6))
                _, u, v = np.intersect1d(at_i, at_j, assume_unique=True, return_indices=True)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), i[r])), pa.array(np.full(len(u), j[r])), pa.array(of_i[u]), pa.array(of_j[v])], ["i", "j", "x", "y"])

    return both.mapInArrow(matched, "i long, j long, x double, y double")


def sky_band(pairs: DataFrame, low: float, high: float) -> DataFrame:
    """The samples of pairs that have enough, between two percentiles of the mean of both values; all where that leaves few."""
    rows = materialize(pairs.select("i", "j", "x", "y"), "overlap-samples")
    mid = (F.col("x") + F.col("y")) / 2
    inside = (F.col("hi") <= F.col("lo")) | mid.between(F.col("lo"), F.col("hi"))
    cuts = rows.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.percentile(mid, F.lit(low)).alias("lo"), F.percentile(mid, F.lit(high)).alias("hi"))
    cuts = materialize(cuts.where(F.col("n") >= LEAST_SAMPLES).select("i", "j", "lo", "hi"), "cuts")
    few = rows.join(normalize.told(cuts), ["i", "j"]).groupBy("i", "j").agg((F.count(F.when(inside, 1)) < LEAST_SKY).alias("few"))
    cuts = materialize(cuts.join(few, ["i", "j"]), "cuts")
    return rows.join(normalize.told(cuts), ["i", "j"]).where(F.col("few") | inside).select("i", "j", "x", "y")


def fit_pairs(edges: DataFrame, samples: DataFrame, *, sky: tuple[float, float] = (0.3, 0.7), sigma: float = 2.5) -> DataFrame:
    """(i, j, a, b, w, n): y_j = a * y_i + b by iterated regression on the sky of each edge."""
    edges = materialize(edges.select("i", "j", "w"), "edges")
    found = normalize.iterated_regression(sky_band(pair_samples(edges, samples), *sky), ["i", "j"], sigma=sigma)
    return found.join(edges.select("i", "j", "w"), ["i", "j"]).select("i", "j", F.col("gain").alias("a"), F.col("offset").alias("b"), "w", "n")


def fit_overlaps(boxes: DataFrame, samples: DataFrame, cell: float, least_fraction: float = 0.0, *, sky: tuple[float, float] = (0.3, 0.7), sigma: float = 2.5) -> DataFrame:
    """``fit_pairs`` of all boxes that share at least such a fraction of one; w is the area. Pairs are found where the samples are."""
    fits, large = overlaps.fit_overlaps(boxes, samples, cell, least_fraction, sky=sky, sigma=sigma, least=LEAST_SAMPLES, least_sky=LEAST_SKY)
    if large is None:
        return fits
    return fits.unionByName(fit_pairs(large, samples, sky=sky, sigma=sigma).select(*fits.columns))


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def constrain(fits: DataFrame, gain: tuple[float, float] = PAIR_GAIN, offset: float = PAIR_OFFSET) -> DataFrame:
    """``fits`` with a reason: kept, non-finite, gain or offset. Where nothing would be kept, the limits are widened to the 1st
    and 99th percentiles of what is finite (slopes near zero stay out). One aggregation decides, for all rows at once."""
    fine = _finite("a") & _finite("b")
    strict = fine & F.col("a").between(*gain) & (F.abs("b") <= offset)
    ok = lambda x: F.when(fine, x)
    at = fits.agg(
        F.count(F.when(strict, 1)).alias("strict"), F.percentile_approx(ok(F.col("a")), [0.01, 0.99], 100000).alias("qa"),
        F.percentile_approx(ok(F.abs("a")), 0.01, 100000).alias("least"), F.percentile_approx(ok(F.abs("b")), 0.99, 100000).alias("qb"),
    )
    r = fits.crossJoin(F.broadcast(at))  # one row
    relaxed = F.col("strict") == 0
    low, high = F.when(relaxed, F.least(F.lit(gain[0]), F.col("qa")[0])).otherwise(gain[0]), F.when(relaxed, F.greatest(F.lit(gain[1]), F.col("qa")[1])).otherwise(gain[1])
    most = F.when(relaxed, F.greatest(F.lit(offset), F.col("qb"))).otherwise(offset)
    flat = relaxed & (F.abs("a") < F.greatest(F.lit(1e-4), F.col("least") * 0.25))
    reason = F.when(~fine, "non-finite").when((F.col("a") < low) | (F.col("a") > high) | flat, "gain").when(F.abs("b") > most, "offset").otherwise("kept")
    return r.select("i", "j", "a", "b", "w", "n", reason.alias("reason"))


def anchor(fits: DataFrame, nodes: DataFrame, weights: DataFrame | None = None) -> int | None:
    """The node of the largest summed weight of its pairs, times the root of its own over the median one; ties to the lower id.
    Without pairs it is the heaviest node."""
    own = nodes.select("id")
    conn = graph.endpoints(fits, "w").groupBy(F.col("node").alias("id")).agg(F.sum("w").alias("c"))
    score = F.coalesce("c", F.lit(0.0))
    if weights is not None:
        good = F.when(_finite("weight") & (F.col("weight") > 0), F.col("weight")).otherwise(1.0)
        w = weights.select("id", good.alias("weight"))
        middle = w.agg(F.percentile_approx("weight", 0.5, 100000).alias("middle"))
        own = own.join(w.crossJoin(F.broadcast(middle)).select("id", F.sqrt(F.col("weight") / F.col("middle")).alias("r")), "id", "left")
        score = F.when(F.col("any") > 0, score).otherwise(1.0) * F.coalesce("r", F.lit(1.0))
        own = own.crossJoin(F.broadcast(conn.agg(F.coalesce(F.max("c"), F.lit(0.0)).alias("any"))))  # one row
    best = own.join(conn, "id", "left").select("id", score.alias("score")).orderBy(F.desc("score"), "id").first()
    return best["id"] if best else None


def medians(samples: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, gain, offset): each tile's median to the median of the positive ones."""
    m = samples.join(nodes.select("id"), "id", "left_semi").groupBy("id").agg(F.median("value").alias("med"))
    target = m.where("med > 0").agg(F.percentile("med", F.lit(0.5)).alias("target"))
    j = nodes.select("id").join(m, "id", "left").crossJoin(F.broadcast(target))  # one row
    gain = F.when(F.col("med").isNotNull() & (F.col("med") != 0), F.coalesce(F.col("target") / F.col("med"), F.lit(1.0))).otherwise(1.0)
    return j.select("id", gain.alias("gain"), F.lit(0.0).alias("offset"))


def calibrate(
    boxes: DataFrame, samples: DataFrame, *, cell: float, min_overlap: float = 0.05, steps: tuple[float, ...] = LADDER, neighbours: int = 8, sky: tuple[float, float] = (0.3, 0.7), sigma: float = 2.5,
    solvers: tuple[str, ...] = ("affine", "offsets", "relaxation"), weights: DataFrame | None = None, ridge: float = RIDGE, gain_clip: tuple[float, float] = GAIN, offset_clip: tuple[float, float] = OFFSET,
    pair_gain: tuple[float, float] = PAIR_GAIN, pair_offset: float = PAIR_OFFSET, **how,
) -> Calibration:
    """``boxes`` are (id, x0, x1, y0, y1), ``samples`` (id, place, value). ``how`` goes to ``graph.least_squares``. A solver that
    doesn't converge, has no pair that is kept, or gives anything not finite hands over to the next."""
    lowest = min([max(0.0, min_overlap), *[s for s in steps if s < min_overlap - 1e-6]])
    kinds = materialize(spatial.overlap_counts(boxes, cell, lowest), "overlaps")
    rung = ladder(kinds, min_overlap, steps, F.col("pairs")).first()
    if rung["threshold"] is None:
        return Calibration(medians(samples, boxes), None, "global-median", None, 0, 0, None)
    if pruned(boxes.count(), rung["pairs"], neighbours):
        raw = spatial.overlap_pairs(boxes, cell, rung["threshold"]).select("i", "j", F.col("area").alias("w"))
        edges = materialize(prune(boxes, materialize(raw, "overlaps"), neighbours), "edges")
        fits = fit_pairs(edges, samples, sky=sky, sigma=sigma)
    else:
        fits = fit_overlaps(boxes, samples, cell, rung["threshold"], sky=sky, sigma=sigma)
    found = materialize(constrain(materialize(fits, "pair-fits"), pair_gain, pair_offset), "pair-fits")
    kept = found.where("reason = 'kept'")
    at, n = anchor(found, boxes, weights), kept.count()
    done = lambda solution, status: Calibration(solution, found, status, rung["threshold"], rung["pairs"], n, at)
    unmoved = boxes.select("id", F.lit(1.0).alias("gain"), F.lit(0.0).alias("offset"))
    if found.isEmpty():
        return done(unmoved, "no-fits")
    for solver in solvers:
        try:
            if solver == "affine" and n:
                x = graph.solve_affine(kept.select("i", "j", "a", "b", "w"), boxes, ridge=ridge, clip=gain_clip, anchor=at, **how)
                x = x.select("id", "gain", F.greatest(F.lit(offset_clip[0]), F.least(F.lit(offset_clip[1]), F.col("offset"))).alias("offset"))
            elif solver == "offsets":
                # with gains of one, y_j + o_j = y_i + o_i asks for o_j - o_i = -b
                x = graph.solve_offsets(found.where(_finite("b")).select("i", "j", (-F.col("b")).alias("b"), "w"), boxes, anchor=at, **how).select("id", F.lit(1.0).alias("gain"), "offset")
            elif solver == "relaxation":
                # it takes y_i = a * y_j + b, and as many votes as samples
                x = graph.relax(found.where(_finite("a") & _finite("b") & (F.col("a") != 0)).select(F.col("j").alias("i"), F.col("i").alias("j"), "a", "b", F.col("n").cast("double").alias("w")), boxes)
            else:
                continue
            x = materialize(x, "calibration")
        except RuntimeError:  # not converged
            continue
        if not x.where(~(_finite("gain") & _finite("offset"))).isEmpty():
            continue
        return done(x, f"solved-{solver}")
    return done(unmoved, "unsolved")
