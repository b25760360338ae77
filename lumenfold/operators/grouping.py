"""Greedy and windowed grouping: islands of angles, overlapping batches, borrowing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import materialize, ship


def orientation_islands(items: DataFrame, group: str, angle: str, key: str, threshold: float) -> DataFrame:
    """(group, key, island): angles sorted around the circle, neighbours within the threshold are one island, the last
    and the first too if they meet over the wrap; items without an angle join the largest island (the first on ties)."""
    a = F.pmod(F.col(angle), F.lit(360.0))
    known = items.where(F.col(angle).isNotNull()).withColumn("_a", a)
    order = Window.partitionBy(group).orderBy("_a", key)
    known = known.withColumn("_new", F.when(F.col("_a") - F.lag("_a").over(order) > threshold, 1).otherwise(0))
    known = known.withColumn("_k", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(group)
    known = known.withColumn("_last", F.max("_k").over(whole)).withColumn("_wrap", F.min("_a").over(whole) + 360 - F.max("_a").over(whole) <= threshold)
    known = known.withColumn("island", F.when(F.col("_wrap") & (F.col("_k") == F.col("_last")), 0).otherwise(F.col("_k")).cast("long")).select(group, key, "island")
    sizes = known.groupBy(group, "island").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy(group).agg(F.min_by("island", F.struct(-F.col("n"), F.col("island"))).alias("island"))
    rest = items.where(F.col(angle).isNull()).select(group, key).join(largest, group, "left").select(group, key, F.coalesce("island", F.lit(0)).alias("island"))
    return known.unionByName(rest)


def overlapping_batches(items: DataFrame, group: str, order: list[Column], cap: int, overlap: float, least: int = 2) -> DataFrame:
    """(group, batch, position, ...): runs of ``cap`` items that start every cap * (1 - overlap); a last run shorter than
    ``least`` belongs to the one before it."""
    step = max(1, int(cap * (1 - overlap)))
    w = Window.partitionBy(group)
    n = items.withColumn("position", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("size", F.count(F.lit(1)).over(w))
    p, size = F.col("position"), F.col("size")
    last = F.when(size <= cap, F.lit(0)).otherwise(F.ceil((size - cap) / step)).cast("long")
    n = n.withColumn("last", last)
    first = F.greatest(F.lit(0), F.ceil((p - cap + 1) / step)).cast("long")
    n = n.withColumn("batch", F.explode(F.sequence(first, F.least(F.floor(p / step), F.col("last")).cast("long"))))
    short = (size - F.col("last") * step < least) & (F.col("last") > 0)
    merged = F.when(short & (F.col("batch") == F.col("last")), F.col("last") - 1).otherwise(F.col("batch"))
    return n.withColumn("batch", merged.cast("long")).drop("last", "size").distinct()


def borrow(items: DataFrame, k: int = 4, border: float = 0.2, quota: float = 0.25) -> DataFrame:
    """(id, home, target) of items (id, grp, x, y) lent to a near group: those in the outer ring of their group (beyond 1 - border
    of the 90th percentile radius) go to the nearest of its k nearest groups, each group giving and each receiving group
    taking at most ceil(quota * the giver's size) of it, farthest from home first; each item once."""
    c = items.groupBy("grp").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n"))
    far = lambda a, b: F.sqrt((F.col(a + "x") - F.col(b + "x")) ** 2 + (F.col(a + "y") - F.col(b + "y")) ** 2)
    i = items.join(c, "grp").withColumn("r", F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2))
    p90 = i.groupBy("grp").agg(F.percentile("r", F.lit(0.9)).alias("p90"))
    ring = i.join(p90, "grp").where(F.col("r") >= (1 - border) * F.col("p90"))
    o = c.select(F.col("grp").alias("target"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    near = c.join(o, F.col("grp") != F.col("target")).withColumn("d", far("c", "o"))  # groups, not items
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy("d", "target"))).where(F.col("k") <= k).select("grp", "target", "ox", "oy")
    to = ring.join(near, "grp").withColumn("d", F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2))
    best = to.groupBy("grp", "id", "r", "n").agg(F.min(F.struct("d", "target")).alias("b")).select("grp", "id", "r", "n", "b.target")
    place = F.row_number().over(Window.partitionBy("grp", "target").orderBy(F.desc("r"), "id"))
    return best.withColumn("p", place).where(F.col("p") <= F.ceil(quota * F.col("n"))).select("id", F.col("grp").alias("home"), "target")


def greedy_orientation(items: DataFrame, group: str, angle: str, key: str, threshold: float) -> DataFrame:
    """(group, key, bucket): in order of the key, an item goes to the first bucket whose first member is within the threshold
    around the circle, or opens one; those without an angle share one. First members lie apart, so a group has at most
    360 / threshold + 1: each round finds the next of every group by one aggregation, and items stay where they are read."""
    a = F.when(~F.isnan(angle), F.col(angle))
    near = lambda h: F.when(a.isNull() | h.isNull(), a.isNull() & h.isNull()).otherwise(F.least(F.pmod(a - h, F.lit(360.0)), F.pmod(h - a, F.lit(360.0))) <= threshold)
    first = F.min(F.struct(key, a.alias("a")))["a"]
    held = lambda heads: items.join(heads, items[group].eqNullSafe(heads["_group"]), "left")
    heads = materialize(items.groupBy(F.col(group).alias("_group")).agg(F.array(first).alias("_heads")), "heads")
    for known in range(1, int(360 // threshold) + 3):
        left = held(heads).where(~F.exists("_heads", near)).groupBy(F.col(group).alias("_next")).agg(F.array(first).alias("_more"))
        longer = F.concat("_heads", F.coalesce("_more", F.slice("_heads", 1, 0)))
        heads = materialize(heads.join(left, F.col("_group").eqNullSafe(F.col("_next")), "left").select("_group", longer.alias("_heads")), "heads")
        if heads.where(F.size("_heads") > known).isEmpty():
            break
    bucket = F.array_position(F.transform("_heads", near), True) - 1
    return held(heads).select(group, key, bucket.cast("int").alias("bucket"))


def coverage_batches(items: DataFrame, group: str, key: str, cells: str, *, total: int, least: int, target: int, share: float) -> DataFrame:
    """(group, key, batch): in order of the key, a group's batch closes when its items cover ``share`` of ``total`` cells (and are at
    least ``least``), or are ``target``; a last batch under ``least`` that didn't close joins the one before. ``cells`` is an array
    of what an item covers. Rows are read as a sorted stream of which a task keeps the open batch's cells alone, so a group of
    any length needs no more; a null group is one."""
    ship(items.sparkSession)
    kinds = [items.schema[c].dataType.simpleString() for c in (group, key)]

    def scan(batches):
        at, batch, seen, n = None, 0, set(), 0
        for b in batches:
            rows = []
            groups, found = b.column(0).to_pylist(), b.column(2).to_pylist()
            for g, c in zip(groups, found, strict=True):
                if at is None or g != at[0]:
                    at, batch, seen, n = (g,), 0, set(), 0
                seen.update(c or ())
                n += 1
                closed = n >= least and len(seen) >= share * total or n >= target
                rows.append((batch, closed))
                if closed:
                    batch, seen, n = batch + 1, set(), 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_())], names=[group, key, "batch", "closed"])

    rows = items.select(group, key, cells).repartition(group).sortWithinPartitions(group, key)
    made = materialize(rows.mapInArrow(scan, f"{group} {kinds[0]}, {key} {kinds[1]}, batch long, closed boolean"), "batches")
    last = made.groupBy(group, "batch").agg(F.count(F.lit(1)).alias("n"), F.bool_or("closed").alias("closed"))
    tail = last.where((F.col("batch") > 0) & ~F.col("closed") & (F.col("n") < least)).select(F.col(group).alias("t_group"), F.col("batch").alias("t_batch"))
    j = made.join(tail, F.col(group).eqNullSafe(F.col("t_group")) & (F.col("batch") == F.col("t_batch")), "left")
    return j.select(group, key, F.when(F.col("t_batch").isNotNull(), F.col("batch") - 1).otherwise(F.col("batch")).alias("batch"))
