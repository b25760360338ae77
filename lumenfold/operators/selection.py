"""Exact order statistics of groups of any size, by counts of cells.

A rank is looked for in its group's range, cut into cells: their counts say which cell holds it, and that cell's least and
greatest value are the next range, until they are equal. A round is one aggregation of partial counts over what lies in
the ranges; no group's values are gathered or sorted, and a group of a third of all rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import materialize

#: Cells of a range: what a round divides it by, and the most rows that it has of a rank.
CELLS = 4096


def quantiles(df: DataFrame, keys: list[str], value: str | Column, names: dict[str, float], cells: int = CELLS) -> DataFrame:
    """(keys, one column for each of ``names``): the values at those shares of each group's order, linear between two ranks, of
    what isn't null or NaN; a group without any has nulls. No keys: one row for all."""
    own = [f"k{i}" for i in range(len(keys))]
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = materialize(df.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.when(~F.isnan(v), v).alias("v")), "values")
    group = F.struct(*own) if own else F.struct(F.lit(0).alias("k"))
    rows = rows.withColumn("g", F.to_json(group, {"ignoreNullFields": "false"}))  # one key, null parts and all
    sizes = rows.groupBy("g", *own).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = lambda q: (F.col("n") - 1) * F.lit(q)
    ranks = F.array(*[f(at(q)).cast("long") for q in dict.fromkeys(names.values()) for f in (F.floor, F.ceil)])
    sizes = materialize(sizes, "sizes")
    todo = sizes.where("n > 0").select("g", F.explode(F.array_distinct(ranks)).alias("rank"), "lo", "hi").withColumn("left", F.col("rank"))
    done = None
    while True:
        todo = materialize(todo, "ranks")
        found = todo.where("lo = hi").select("g", "rank", F.col("lo").alias("found"))
        done = found if done is None else done.unionByName(found)
        todo = todo.where("lo < hi")
        if todo.isEmpty():
            break
        held = rows.where("v is not null").select("g", "v").join(todo, "g").where(F.col("v").between(F.col("lo"), F.col("hi")))
        cell = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * cells), F.lit(cells - 1))
        counted = held.groupBy("g", "rank", "left", cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.sum("c").over(Window.partitionBy("g", "rank").orderBy("cell")) - F.col("c")  # cells of one rank, no more than ``cells``
        counted = counted.withColumn("before", before).where((F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("c")))
        todo = counted.select("g", "rank", "lo", "hi", (F.col("left") - F.col("before")).alias("left"))
    by = done.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "found"))).alias("m"))  # two ranks for each name
    j = sizes.join(by.withColumnRenamed("g", "m_g"), F.col("g") == F.col("m_g"), "left")

    def between(q: float) -> Column:
        low, high = (F.col("m")[f(at(q)).cast("long")] for f in (F.floor, F.ceil))
        return F.when(F.col("n") > 0, low + (high - low) * (at(q) - F.floor(at(q))))

    return j.select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], *[between(q).alias(name) for name, q in names.items()])


def beside(told: DataFrame, df: DataFrame, keys: list[str], value: str | Column, names: dict[str, float]) -> DataFrame:
    """``told`` (one row for each group of ``keys``) with its quantiles in ``df``; null keys are a group."""
    found = quantiles(df, keys, value, names)
    found = found.select(*[F.col(k).alias(f"q_{k}") for k in keys], *names)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"q_{k}"))
    return told.join(found, same, "left").drop(*[f"q_{k}" for k in keys])
