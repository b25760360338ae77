"""Fits of all overlapping tiles, in blocks: a task holds the samples of tiles that lie close, and fits their pairs there.

A tile is a box in three dimensions, the third being the range of its places. Tiles are dealt to coarse cells, and a pair is
fitted only in the cell that holds the corner where the two begin to meet. So a sample is sent once for each cell of its tile,
not once for each pair, and nothing that has a row for each sample of a pair is ever sent or written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import graph, spatial
from lumenfold.session import materialize, ship

#: Places that an array of a tile's samples covers.
STRETCH = 4096
#: Sides of a cell here, in cells of the boxes: larger ones send fewer copies of a sample.
SPAN = 4
#: Samples of a crowded cell that make a block, of which a task holds two; a tile counts as so many at least.
BLOCK, TILE = 1 << 20, 256
#: Samples of pairs that are fitted at once.
BATCH = 1 << 20
#: Samples of a tile that a task takes whole.
MOST = BLOCK // 2
OUT = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("a", pa.float64()), ("b", pa.float64()), ("w", pa.float64()), ("n", pa.int64())])


def stretches(samples: DataFrame) -> DataFrame:
    """(id, stretch, first, last, places, values) of samples (id, place, value); places count from the stretch's first. Samples
    that are dealt by (id, stretch) already aren't sent again."""
    fine = samples.where(F.col("id").isNotNull() & F.col("place").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    fine = fine if "stretch" in samples.columns else fine.withColumn("stretch", F.floor(F.col("place") / STRETCH))
    at = (F.col("place") - F.col("stretch") * STRETCH).cast("int")
    return fine.groupBy("id", "stretch").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.collect_list(at).alias("places"), F.collect_list("value").alias("values"))


def _line(run: np.ndarray, x: np.ndarray, y: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slope, intercept and number of each run's samples; a run whose x are one has no slope (NaN)."""
    n = np.bincount(run, minlength=runs)
    with np.errstate(all="ignore"):
        mx, my = (np.bincount(run, v, runs) / n for v in (x, y))
        dx, dy = x - mx[run], y - my[run]
        slope = np.bincount(run, dx * dy, runs) / np.bincount(run, dx * dx, runs)
        first = x[np.minimum(np.searchsorted(run, np.arange(runs)), max(len(x) - 1, 0))] if len(x) else np.zeros(runs)
        slope[np.bincount(run, x != first[run], runs) == 0] = np.nan
        return slope, my - slope * mx, n


def fit_runs(run: np.ndarray, x: np.ndarray, y: np.ndarray, *, sky: tuple[float, float], least: int, least_sky: int, sigma: float, rounds: int = 6, few: int = 16, stop: int = 8):
    """(run, a, b, n) of the runs (sorted) that have ``least`` samples: y = a * x + b on those between two percentiles of the mean
    of both (all where that leaves fewer than ``least_sky``), as ``calibration.sky_band`` and ``normalize.iterated_regression``."""
    n = np.bincount(run)
    held = np.flatnonzero(n >= least)
    place = np.full(len(n), -1)
    place[held] = np.arange(len(held))
    inside = place[run] >= 0
    run, x, y, n, runs = place[run[inside]], x[inside], y[inside], n[held], len(held)
    if not runs:
        return held, np.empty(0), np.empty(0), n
    mid = (x + y) / 2
    ordered, begin = mid[np.lexsort((mid, run))], np.concatenate([[0], np.cumsum(n)[:-1]])

    def cut(q: float) -> np.ndarray:
        at = (n - 1) * q
        low, high = np.floor(at), np.ceil(at)
        u, v = ordered[begin + low.astype(np.int64)], ordered[begin + high.astype(np.int64)]
        return np.where(u == v, u, (high - at) * u + (at - low) * v)  # as Spark and SQL do: a cut may fall a hair from a sample

    lo, hi = cut(sky[0]), cut(sky[1])
    inside = (hi <= lo)[run] | ((mid >= lo[run]) & (mid <= hi[run]))
    inside |= (np.bincount(run[inside], minlength=runs) < least_sky)[run]
    run, x, y = run[inside], x[inside], y[inside]
    slope, shift, n = _line(run, x, y, runs)
    total = n
    going = total >= few
    for _ in range(rounds):
        stay = going[run]
        run, x, y = run[stay], x[stay], y[stay]
        if not len(run):
            break
        r = y - slope[run] * x - shift[run]
        with np.errstate(all="ignore"):
            count = np.bincount(run, minlength=runs)
            mean = np.bincount(run, r, runs) / count
            rs = np.sqrt(np.bincount(run, (r - mean[run]) ** 2, runs) / count)
            near = np.abs(r) <= sigma * rs[run]
        left = np.bincount(run[near], minlength=runs)
        going = going & (rs > 1e-6) & (left >= stop)
        near &= going[run]
        run, x, y = run[near], x[near], y[near]
        now = _line(run, x, y, runs)
        slope, shift, n = (np.where(going, a, b) for a, b in zip(now, (slope, shift, n), strict=True))
    small = total < few
    return held, np.where(small | np.isnan(slope), 1.0, slope), np.where(small | np.isnan(shift), 0.0, shift), n


def _pairs(t: dict[str, np.ndarray], cell: tuple[int, int, int], side: float, places: int, fraction: float, apart: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tiles i, j and their area, for pairs whose boxes and places meet first in this cell."""
    whole = (t["x1"] - t["x0"]) * (t["y1"] - t["y0"])
    step = max(1, (1 << 21) // len(whole))
    for k in range(0, len(whole), step):
        a = {c: v[k : k + step, None] for c, v in t.items()}
        left, low, first = np.maximum(a["x0"], t["x0"]), np.maximum(a["y0"], t["y0"]), np.maximum(a["first"], t["first"])
        dx, dy = np.minimum(a["x1"], t["x1"]) - left, np.minimum(a["y1"], t["y1"]) - low
        hit = (a["id"] < t["id"]) & (left < np.minimum(a["x1"], t["x1"])) & (low < np.minimum(a["y1"], t["y1"])) & (first <= np.minimum(a["last"], t["last"]))
        hit &= (np.floor(left / side) == cell[1]) & (np.floor(low / side) == cell[2]) & (first // places == cell[0])
        if apart:
            hit &= a["own"] != t["own"]
        i, j = np.nonzero(hit)
        area = dx[i, j] * dy[i, j]
        with np.errstate(all="ignore"):
            enough = np.maximum(area / whole[i + k], area / whole[j]) >= fraction
        yield i[enough] + k, j[enough], area[enough]


def _fitted(table: pa.Table, cell: tuple[int, ...], side: float, places: int, fraction: float, **how) -> Iterator[pa.RecordBatch]:
    table = table.combine_chunks()
    lists, values = (table.column(c).chunk(0) for c in ("places", "values"))
    ids, row, tile = np.unique(table.column("id").to_numpy(), return_index=True, return_inverse=True)
    t = {"id": ids} | {c: table.column(c).to_numpy()[row] for c in ("own", "x0", "x1", "y0", "y1", "first", "last")}
    sizes = lists.value_lengths().to_numpy()
    of = np.repeat(tile, sizes)
    at = lists.flatten().to_numpy() + np.repeat(table.column("stretch").to_numpy() * STRETCH, sizes)
    low, reach = at.min(), int(at.max()) - int(at.min()) + 1
    at = at - low
    if reach * len(ids) >= 1 << 62:
        at = np.unique(at, return_inverse=True)[1]
        reach = int(at.max()) + 1
    key = of * reach + at
    order = np.argsort(key)
    key, of, at, value = key[order], of[order], at[order], values.flatten().to_numpy()[order]
    begin = np.searchsorted(of, np.arange(len(ids) + 1))
    length = np.diff(begin)
    for i, j, area in _pairs(t, cell[:3], side, places, fraction, cell[3] != cell[4]):
        ends = np.cumsum(length[j])
        k = 0
        while k < len(i):
            stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + BATCH, "right")))
            u, v, n = i[k:stop], j[k:stop], length[j[k:stop]]
            run = np.repeat(np.arange(len(u)), n)
            theirs = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[v], n)
            asked = np.repeat(u * reach, n) + at[theirs]
            ours = np.minimum(np.searchsorted(key, asked), len(key) - 1)
            same = key[ours] == asked
            held, a, b, m = fit_runs(run[same], value[ours[same]], value[theirs[same]], **how) if same.any() else (np.empty(0, np.int64),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids[u[held]], ids[v[held]], a, b, area[k:stop][held], m), OUT, strict=True)], schema=OUT)
            k = stop


def fit_overlaps(boxes: DataFrame, samples: DataFrame, cell: float, least_fraction: float = 0.0, *, sky: tuple[float, float], sigma: float, least: int, least_sky: int) -> tuple[DataFrame, DataFrame | None]:
    """(i, j, a, b, w, n) of the overlapping boxes (id, x0, x1, y0, y1), w being the area that they share, and the pairs (i, j, w) that
    are left: those of a tile that has more than ``MOST`` samples."""
    ship(boxes.sparkSession)
    held = materialize(stretches(samples), "stretches")
    fine = boxes.select(F.col("id").cast("long").alias("id"), *spatial.SIDES).na.drop()
    tiles = held.groupBy("id").agg(F.sum(F.size("places")).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    tiles = materialize(tiles.join(graph.told(fine), "id"), "tiles")
    at = tiles.agg(F.percentile_approx(F.col("last") - F.col("first") + 1, 0.5), F.max("n")).first()
    side, places, most = cell * SPAN, max(STRETCH, at[0] or 0), MOST
    cells = lambda a, by: F.sequence(F.floor(F.col(a + "0") / by), F.floor(F.col(a + "1") / by))
    dealt = tiles.where(F.col("n") <= most).select("*", F.explode(F.sequence(F.floor(F.col("first") / places), F.floor(F.col("last") / places))).alias("cs"))
    dealt = dealt.select("*", F.explode(cells("x", side)).alias("cx")).select("*", F.explode(cells("y", side)).alias("cy"))
    where = ["cs", "cx", "cy"]
    blocks = dealt.groupBy(*where).agg(F.ceil(F.sum(F.greatest("n", F.lit(TILE))) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("tiles")).where("tiles > 1").drop("tiles")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = dealt.join(graph.told(materialize(blocks, "blocks")), where).withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    task = F.struct(*where, F.least("own", "k").alias("p"), F.greatest("own", "k").alias("q"), "own")
    tasks = materialize(dealt.groupBy("id").agg(*[F.first(c).alias(c) for c in ("first", "last", *spatial.SIDES)], F.collect_list(task).alias("tasks")), "tasks")
    sent = held.select("id", "stretch", "places", "values").join(graph.told(tasks), "id").select("id", "stretch", "places", "values", "first", "last", *spatial.SIDES, F.explode("tasks").alias("t"))
    keys = [*where, "p", "q"]

    def fit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = _fitted(table, tuple(k.as_py() for k in key), side, places, least_fraction, sky=sky, sigma=sigma, least=least, least_sky=least_sky)
        return pa.Table.from_batches(found, OUT)

    fits = sent.select("*", "t.*").drop("t").groupBy(*keys).applyInArrow(fit, "i long, j long, a double, b double, w double, n long")
    if (at[1] or 0) <= most:
        return fits, None
    large = fine.join(graph.told(tiles.select("id", (F.col("n") > most).alias("part"))), "id")
    end = lambda k, p: large.select(F.col("id").alias(k), *[F.col(c).alias(p + c) for c in (*spatial.SIDES, "part")])
    p = spatial.box_join(end("i", "a_"), end("j", "b_"), cell, inclusive=False, extra=(F.col("i") < F.col("j")) & (F.col("a_part") | F.col("b_part")))
    shared = lambda a: F.least(f"a_{a}1", f"b_{a}1") - F.greatest(f"a_{a}0", f"b_{a}0")
    whole = lambda p: (F.col(p + "x1") - F.col(p + "x0")) * (F.col(p + "y1") - F.col(p + "y0"))
    p = p.select("i", "j", (shared("x") * shared("y")).alias("w"), whole("a_").alias("ai"), whole("b_").alias("aj"))
    return fits, p.where(F.greatest(F.col("w") / F.col("ai"), F.col("w") / F.col("aj")) >= least_fraction).select("i", "j", "w")
