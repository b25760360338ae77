"""Merging, splitting and topping up of groups on the sphere, in rounds over all groups at once.

Groups are records (grp, mode, n, dispersion, vx, vy, vz, radius) of members (id, grp, mode, ra, dec): a mean direction, the
farthest member's angle from it, and a bound on the distance of two members. A record's partners are those of its
nearest of one mode with which it stays within the cap and the bound; a round joins all pairs that are each other's
best. The best pair of all is one of them, so rounds go on until no pair is left. Only records are joined with each
other, by cells of the sphere no larger than needed, and only pairs that may merge; members are told their new group by
one join a round.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.grouping import overlapping_batches
from lumenfold.session import materialize

#: Of the nearest records only so many are looked at (a fixed value that must equal the grouping's that this one replaces).
NEAREST = 64
#: Records among which a search needs no small cells.
FEW = 4096
_R = math.pi / 180


def _direction(ra: str = "ra", dec: str = "dec"):
    a, b = F.col(ra) * _R, F.col(dec) * _R
    return [(F.cos(b) * F.cos(a)).alias("vx"), (F.cos(b) * F.sin(a)).alias("vy"), F.sin(b).alias("vz")]


def _angle(p: str = "v", q: str = "o"):
    """Degrees between two unit vectors; the chord keeps small angles exact."""
    chord = F.sqrt((F.col(p + "x") - F.col(q + "x")) ** 2 + (F.col(p + "y") - F.col(q + "y")) ** 2 + (F.col(p + "z") - F.col(q + "z")) ** 2)
    return F.degrees(2 * F.asin(F.least(chord / 2, F.lit(1.0))))


def describe(members: DataFrame) -> DataFrame:
    """(grp, mode, n, dispersion, vx, vy, vz, radius); dispersion is twice the radius, mode MIXED where members differ.
    Members without a position count, but don't place a group; a group without any is left out."""
    v = members.select("grp", "mode", *_direction())
    sums = v.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.when(F.min("mode").eqNullSafe(F.max("mode")), F.min("mode")).otherwise("MIXED").alias("mode"), *[F.sum(c).alias(c) for c in ("vx", "vy", "vz")])
    length = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2)
    c = sums.where(length > 0).select("grp", "mode", "n", *[(F.col(x) / length).alias(x) for x in ("vx", "vy", "vz")])
    far = v.join(c.select("grp", *[F.col("v" + x).alias("o" + x) for x in "xyz"]), "grp").groupBy("grp").agg(F.coalesce(F.max(_angle()), F.lit(0.0)).alias("radius"))
    return c.join(far, "grp").select("grp", F.coalesce("mode", F.lit("UNKNOWN")).alias("mode"), "n", (2 * F.col("radius")).alias("dispersion"), "vx", "vy", "vz", "radius")


def near(records: DataFrame, others: DataFrame, within: float, k: int, fits) -> DataFrame:
    """(grp, other, far) of each record's k nearest others within ``within`` degrees that ``fits`` (a condition on its columns and
    the other's, named with o_ before). Cells grow from a sixteenth of the reach: a record that has k others within a cell's
    side is done, so where records lie dense they meet few."""
    reach = 2 * math.sin(min(within, 180.0) * _R / 2) * (1 + 1e-9)
    o = others.select(*[F.col(c).alias("o_" + c) for c in others.columns if c not in ("vx", "vy", "vz")], *[F.col("v" + x).alias("o" + x) for x in "xyz"])
    todo, done = records, None
    few = others.limit(FEW + 1).count() <= FEW  # then no cell holds many
    for c in (reach,) if few else (reach / 16, reach / 4, reach):
        spread = todo
        for x in "xyz":
            spread = spread.withColumn("c" + x, F.explode(F.array(*[F.floor(F.col("v" + x) / c) + i for i in (-1, 0, 1)])))
        cells = o.select("*", *[F.floor(F.col("o" + x) / c).alias("c" + x) for x in "xyz"])
        j = spread.join(cells, ["cx", "cy", "cz"]).where((F.col("grp") != F.col("o_grp")) & fits).withColumn("far", _angle())
        most = min(within, 2 * math.asin(min(1.0, c / 2)) / _R) if c < reach else within
        ranked = j.where(F.col("far") <= most).select("grp", F.col("o_grp").alias("other"), "far", F.row_number().over(Window.partitionBy("grp").orderBy("far", "o_grp")).alias("rank")).where(F.col("rank") <= k)
        ranked = materialize(ranked, "near")
        if c == reach:
            return ranked.select("grp", "other", "far") if done is None else done.unionByName(ranked.select("grp", "other", "far"))
        full = ranked.where(F.col("rank") == k).select("grp")
        found = ranked.join(full, "grp", "left_semi").select("grp", "other", "far")
        done = found if done is None else done.unionByName(found)
        todo = materialize(todo.join(full, "grp", "left_anti"), "near-left")
    raise AssertionError


def best_pairs(records: DataFrame, cap: int | None, target: int, limit: float, neighbours: int = NEAREST) -> DataFrame:
    """(i, j, n, dispersion) of pairs that are each other's best: the size nearest the target, then the least bound, then the
    least distance, then the lower ids."""
    fits = (F.col("mode") == F.col("o_mode")) & (F.lit(True) if cap is None else F.col("n") + F.col("o_n") <= cap)
    found = near(records, records.select("grp", "mode", "n", "vx", "vy", "vz"), limit, neighbours, fits)
    pairs = found.select(F.least("grp", "other").alias("i"), F.greatest("grp", "other").alias("j"), "far").groupBy("i", "j").agg(F.min("far").alias("far"))
    side = lambda k: records.select(F.col("grp").alias(k), F.col("n").alias(k + "n"), F.col("dispersion").alias(k + "d"), F.col("radius").alias(k + "r"))
    n = F.col("in") + F.col("jn")
    p = pairs.join(side("i"), "i").join(side("j"), "j").select("i", "j", n.alias("n"), "far", F.greatest("id", "jd", F.col("far") + F.col("ir") + F.col("jr")).alias("dispersion"))
    order = F.struct(F.abs(F.lit(target) - F.col("n")).alias("score"), "dispersion", "far", "i", "j", "n")
    p = materialize(p.where(F.col("dispersion") <= limit).select("i", "j", order.alias("pair")), "pairs")
    best = p.select(F.explode(F.array("i", "j")).alias("grp"), "pair").groupBy("grp").agg(F.min("pair").alias("pair"))
    both = best.groupBy("pair").agg(F.count(F.lit(1)).alias("c")).where("c = 2")
    return both.select("pair.i", "pair.j", "pair.n", "pair.dispersion")


def merge(members: DataFrame, *, cap: int | None, target: int, limit: float, neighbours: int = NEAREST) -> DataFrame:
    """Members with the group that theirs ended in: pairs merge, into the lower id, until no pair may."""
    if limit <= 0:
        raise ValueError("a bound on the dispersion is needed")
    held = materialize(members.select("id", "grp", "mode", "ra", "dec"), "members")
    records = materialize(describe(held), "records")
    while True:
        pairs = materialize(best_pairs(records, cap, target, limit, neighbours), "merged")
        if pairs.isEmpty():
            return held
        to = pairs.select(F.col("j").alias("grp"), F.col("i").alias("into"))
        held = materialize(held.join(to, "grp", "left").select("id", F.coalesce("into", "grp").alias("grp"), "mode", "ra", "dec"), "members")
        changed = describe(held.join(pairs.select(F.col("i").alias("grp")), "grp", "left_semi")).drop("dispersion").join(pairs.select(F.col("i").alias("grp"), "dispersion"), "grp")
        gone = pairs.select(F.explode(F.array("i", "j")).alias("grp"))
        records = materialize(records.join(gone, "grp", "left_anti").unionByName(changed.select(*records.columns)), "records")


def absorb(members: DataFrame, *, least: int, cap: int, reach: float = 180.0) -> DataFrame:
    """Members with small groups (under ``least``) taken in by the nearest group of their mode, within the cap and ``reach``
    degrees. Each round every small group asks its nearest; of requests that share a group, that of the smallest group (then
    the nearest, then the lowest ids) is granted, so that no group is both taken in and takes in; centres are made anew. The
    best request of all is granted, so rounds end."""
    held = materialize(members.select("id", "grp", "mode", "ra", "dec"), "members")
    records = materialize(describe(held), "records")
    while True:
        small = records.where(F.col("n") < least)
        fits = (F.col("mode") == F.col("o_mode")) & (F.col("n") + F.col("o_n") <= cap)
        asked = near(small, records.select("grp", "mode", "n", "vx", "vy", "vz"), reach, 1, fits).join(small.select("grp", "n"), "grp")
        asked = materialize(asked.select(F.struct("n", "far", "grp", "other").alias("ask")), "asked")
        best = asked.select(F.explode(F.array("ask.grp", "ask.other")).alias("at"), "ask").groupBy("at").agg(F.min("ask").alias("ask"))
        granted = materialize(best.groupBy("ask").agg(F.count(F.lit(1)).alias("c")).where("c = 2").select("ask.grp", F.col("ask.other").alias("into")), "granted")
        if granted.isEmpty():
            return held
        held = materialize(held.join(granted, "grp", "left").select("id", F.coalesce("into", "grp").alias("grp"), "mode", "ra", "dec"), "members")
        taken = granted.select(F.col("into").alias("grp"))
        changed = describe(held.join(taken, "grp", "left_semi"))
        gone = granted.select(F.explode(F.array("grp", "into")).alias("grp"))
        records = materialize(records.join(gone, "grp", "left_anti").unionByName(changed.select(*records.columns)), "records")


def split(members: DataFrame, cap: int | None, overlap: float, least: int) -> DataFrame:
    """Members with groups over the cap cut into overlapping runs in order of position; a group is numbered anew by its old number
    and the run (grp * 2^20 + run), so numbers stay apart."""
    if cap is None:
        return members
    size = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    large = members.join(size.where(F.col("n") > cap).select("grp"), "grp", "left_semi")
    runs = overlapping_batches(large, "grp", [F.col("ra").asc_nulls_last(), F.col("dec").asc_nulls_last(), F.col("id")], cap, overlap, min(least, cap))
    # a short last run belongs to the one before it, which may pass the cap by what it adds: cut it back from the front
    place = F.row_number().over(Window.partitionBy("grp", "batch").orderBy(F.desc("position")))
    whole = runs.withColumn("back", place)
    first = whole.groupBy("grp", "batch").agg(F.count(F.lit(1)).alias("m"))
    over = whole.join(first.where(F.col("m") > cap), ["grp", "batch"])
    spill = over.where(F.col("back") > cap).select("id", "grp", "mode", "ra", "dec", (F.col("batch") + (1 << 19)).alias("batch"))
    kept = whole.join(first.where(F.col("m") > cap).select("grp", "batch"), ["grp", "batch"], "left_anti").select("id", "grp", "mode", "ra", "dec", "batch")
    kept = kept.unionByName(over.where(F.col("back") <= cap).select("id", "grp", "mode", "ra", "dec", "batch")).unionByName(spill)
    small = members.join(size.where(F.col("n") <= cap).select("grp"), "grp", "left_semi").withColumn("batch", F.lit(0).cast("long"))
    return small.unionByName(kept).select("id", (F.col("grp") * (1 << 20) + F.col("batch")).alias("grp"), "mode", "ra", "dec")


def top_up(members: DataFrame, *, target: int, cap: int | None, reach: float, donors: int = 8) -> DataFrame:
    """Members and, for groups below the target, copies of the nearest members of the nearest groups that are large enough (over
    0.6 of the target, and over two) and not of the other mount mode: donors in order of distance, members of each in order
    of distance, up to the target. A round asks ``donors`` groups; what a group still lacks goes on to the next round
    among donors not yet asked, until every donor within ``reach`` degrees was."""
    goal = target if cap is None else min(target, cap)
    held = materialize(members, "members")
    records = materialize(describe(held), "records")
    give = materialize(records.where(F.col("n") > max(2, int(target * 0.6))), "donors")
    asked = None
    debts = records.where(F.col("n") < goal)
    while True:
        other = lambda a, b: F.col(a).isin("EQ", "ALT_AZ") & F.col(b).isin("EQ", "ALT_AZ") & (F.col(a) != F.col(b))
        found = near(debts, give.select("grp", "mode", "n", "vx", "vy", "vz"), reach, donors if asked is None else donors * 2 ** len(asked), ~other("mode", "o_mode"))
        for old in asked or []:
            found = found.join(old, ["grp", "other"], "left_anti")
        found = materialize(found, "asked")
        if found.isEmpty():
            return held
        asked = [*(asked or []), found.select("grp", "other")]
        rank = F.row_number().over(Window.partitionBy("grp").orderBy("far", "other"))
        place = debts.select("grp", "n", *[F.col("v" + x).alias("o" + x) for x in "xyz"])
        lent = found.withColumn("rank", rank).join(place, "grp").join(held.select(F.col("grp").alias("other"), F.col("id").alias("lent"), F.col("mode").alias("l_mode"), "ra", "dec", *_direction()), "other")
        own = held.select("grp", F.col("id").alias("lent"))
        lent = lent.join(own, ["grp", "lent"], "left_anti").withColumn("d", F.coalesce(_angle(), F.lit(360.0)))
        one = lent.groupBy("grp", "lent", "n").agg(F.min(F.struct("rank", "d", "l_mode", "ra", "dec")).alias("b"))
        first = one.withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy("b.rank", "b.d", "lent"))).where(F.col("k") <= F.lit(goal) - F.col("n"))
        new = materialize(first.select(F.col("lent").alias("id"), "grp", F.col("b.l_mode").alias("mode"), "b.ra", "b.dec"), "lent")
        held = held.unionByName(new)
        got = new.groupBy("grp").agg(F.count(F.lit(1)).alias("got"))
        debts = materialize(debts.join(got, "grp", "left").withColumn("n", F.col("n") + F.coalesce("got", F.lit(0))).drop("got").where(F.col("n") < goal), "debts")


def optimise(members: DataFrame, *, cap: int | None, least: int, target: int, overlap: float, threshold: float = 0.18, cover: bool = False) -> DataFrame:
    """Members (id, grp, mode, ra, dec) of the groups after merging, splitting, merging again and, if asked, topping up."""
    limit, goal = max(0.15, threshold * 1.5), cap or max(least, target)
    held = merge(members, cap=cap, target=goal, limit=limit)
    held = merge(split(held, cap, max(0.0, min(0.7, overlap)), least), cap=cap, target=goal, limit=limit)
    return top_up(held, target=goal, cap=cap, reach=8 * limit) if cover else held
