"""Queries of merging and optimising groups: items of a mount in one cell of the sky begin as one group."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import merging as M
from lumenfold.plans.base import registry
from lumenfold.plans.grouping import grouped

QUERIES, SQL, query = registry()
CELL, LIMIT, CAP, TARGET = 4.0, 14.0, 40, 40


def members(spark, d):
    """(id, grp, mode, ra, dec)"""
    g = grouped(spark, d)
    code = F.when(F.col("mode") == "EQ", 0).when(F.col("mode") == "ALT_AZ", 1).otherwise(2)
    return g.select("id", ((F.floor(F.col("ra") / CELL) * 64 + F.floor((F.col("dec") + 90) / CELL)) * 3 + code).cast("long").alias("grp"), "mode", "ra", "dec")


@query(None)
def auto_merge(spark, d):
    """Each item's group after pairs of groups that are each other's best have merged until none may."""
    return M.merge(members(spark, d), cap=CAP, target=TARGET, limit=LIMIT).select("id", "grp")


@query(None)
def auto_optimise(spark, d):
    """Groups after merging, splitting, merging again and topping up: an item may be in several."""
    m = M.optimise(members(spark, d).withColumn("grp", F.floor(F.col("grp") / 24)), cap=CAP, least=5, target=TARGET, overlap=0.25, threshold=LIMIT / 1.5, cover=True)
    return m.select("id", "grp")
