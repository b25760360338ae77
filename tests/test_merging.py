"""Merging of groups against the same rounds in plain Python; what splitting and topping up must keep."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from lumenfold.operators import merging as M

KIND = "id long, grp long, mode string, ra double, dec double"


def direction(ra, dec):
    a, b = math.radians(ra), math.radians(dec)
    return math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b)


def angle(p, q):
    return math.degrees(2 * math.asin(min(1.0, math.dist(p, q) / 2)))


def describe(rows):
    groups = defaultdict(list)
    for _, g, m, ra, dec in rows:
        groups[g].append((m, direction(ra, dec)))
    out = {}
    for g, members in groups.items():
        s = [sum(c) for c in zip(*(v for _, v in members), strict=True)]
        norm = math.hypot(*s)
        c = tuple(x / norm for x in s)
        modes = {m for m, _ in members}
        r = max(angle(v, c) for _, v in members)
        out[g] = {"n": len(members), "mode": modes.pop() if len(modes) == 1 else "MIXED", "c": c, "r": r, "d": 2 * r}
    return out


def brute_merge(rows, cap, target, limit, nearest):
    rows, records = list(rows), describe(rows)
    while True:
        edges = {}
        for a, p in records.items():
            far = sorted((angle(p["c"], q["c"]), b) for b, q in records.items() if b != a and q["mode"] == p["mode"] and p["n"] + q["n"] <= cap)
            for d, b in far[:nearest]:
                i, j = min(a, b), max(a, b)
                bound = max(p["d"], records[b]["d"], d + p["r"] + records[b]["r"])
                if bound <= limit:
                    n = p["n"] + records[b]["n"]
                    edges[i, j] = (abs(target - n), round(bound, 9), round(d, 9), i, j, bound)
        best = {}
        for (i, j), e in edges.items():
            for k in (i, j):
                best[k] = min(best.get(k, e), e)
        both = {(i, j) for (i, j), e in edges.items() if best[i] == e and best[j] == e}
        if not both:
            return {r[0]: r[1] for r in rows}
        into = {j: i for i, j in both}
        rows = [(r[0], into.get(r[1], r[1]), *r[2:]) for r in rows]
        fresh = describe(rows)
        for i, j in both:
            records[i] = fresh[i] | {"d": edges[i, j][5]}
            del records[j]


def sky(seed, n=250, groups=70):
    rng = random.Random(seed)
    centres = [(rng.choice([rng.uniform(0, 30), rng.uniform(350, 360)]), rng.uniform(-70, -40)) for _ in range(groups)]
    rows = []
    for i in range(n):
        g = rng.randrange(groups)
        rows.append((i, g, ("EQ", "ALT_AZ", "UNKNOWN")[g % 3], (centres[g][0] + rng.gauss(0, 0.3)) % 360, centres[g][1] + rng.gauss(0, 0.3)))
    return rows


@pytest.mark.parametrize("nearest", [64, 2])
def test_merging_follows_plain_rounds(spark, nearest):
    rows = sky(nearest)
    df = spark.createDataFrame(rows, KIND).repartition(4)
    got = {r["id"]: r["grp"] for r in M.merge(df, cap=16, target=16, limit=7.0, neighbours=nearest).collect()}
    assert got == brute_merge(rows, 16, 16, 7.0, nearest)
    assert 5 < len(set(got.values())) < 50


def test_what_stays_apart(spark):
    rows = [(1, 1, "EQ", 10.0, 0.0), (2, 2, "ALT_AZ", 10.1, 0.0), (3, 3, "EQ", 60.0, 0.0), (4, 4, "EQ", None, 0.0), (5, 5, "EQ", 10.2, 0.0), (6, 6, None, 10.0, 0.0)]
    df = spark.createDataFrame(rows, KIND)
    got = {r["id"]: r["grp"] for r in M.merge(df, cap=10, target=10, limit=1.0).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 6}
    assert {r["id"]: r["grp"] for r in M.merge(df, cap=1, target=10, limit=1.0).collect()} == {k: k for k in range(1, 7)}
    assert M.merge(df.where("false"), cap=10, target=10, limit=1.0).count() == 0
    with pytest.raises(ValueError, match="bound"):
        M.merge(df, cap=10, target=10, limit=0.0)


def test_optimised_groups_keep_their_promises(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, "EQ", rng.uniform(100, 103), rng.uniform(0, 3)) for i in range(90)] + [(100 + i, 10 + i % 9, "EQ", rng.uniform(103, 106), rng.uniform(0, 3)) for i in range(30)]
    rows += [(200 + i, 30, "ALT_AZ", rng.uniform(100, 101), 1.0) for i in range(4)] + [(300, 31, "EQ", 250.0, 40.0)]
    df = spark.createDataFrame(rows, KIND)
    plain = M.optimise(df, cap=20, least=5, target=20, overlap=0.2, threshold=4.0).collect()
    sizes = Counter(r["grp"] for r in plain)
    assert {r["id"] for r in plain} == {r[0] for r in rows}
    assert max(sizes.values()) <= 20
    assert len({(r["id"], r["grp"]) for r in plain}) == len(plain)
    full = M.optimise(df, cap=20, least=5, target=20, overlap=0.2, threshold=4.0, cover=True).collect()
    after = Counter(r["grp"] for r in full)
    assert {(r["id"], r["grp"]) for r in plain} <= {(r["id"], r["grp"]) for r in full}
    assert len({(r["id"], r["grp"]) for r in full}) == len(full)
    assert max(after.values()) <= 20
    modes = defaultdict(set)
    for r in full:
        modes[r["grp"]].add(r["mode"])
    assert all(len(m) == 1 for m in modes.values())
    # everyone near a donor is topped up to the goal; the far one and the other mount have none
    lone = {r["grp"] for r in full if r["id"] == 300 or r["mode"] == "ALT_AZ"}
    assert {g for g, n in after.items() if n < 20} == lone
    assert M.optimise(df.where("false"), cap=20, least=5, target=20, overlap=0.2, cover=True).count() == 0


def test_debts_are_carried_to_farther_donors(spark):
    """The nearest donor's members are the debtor's already, so that what is missing comes from the next."""
    rows = [(i, 1, "EQ", 10 + i / 100, 0.0) for i in range(8)] + [(i, 2, "EQ", 10 + i / 100, 0.1) for i in range(8)] + [(20 + i, 3, "EQ", 12 + i / 100, 0.0) for i in range(10)]
    got = defaultdict(set)
    for r in M.top_up(spark.createDataFrame(rows, KIND), target=10, cap=None, reach=5.0, donors=1).collect():
        got[r["grp"]].add(r["id"])
    assert got[1] == got[2] == {*range(8), 20, 21}
    assert got[3] == set(range(20, 30))


def brute_absorb(rows, least, cap):
    rows, records = list(rows), describe(rows)
    while True:
        asks = []
        for a, p in records.items():
            if p["n"] < least:
                far = sorted((round(angle(p["c"], q["c"]), 9), b) for b, q in records.items() if b != a and q["mode"] == p["mode"] and p["n"] + q["n"] <= cap)
                asks += [(p["n"], far[0][0], a, far[0][1])] if far else []
        best = {}
        for ask in asks:
            for k in ask[2:]:
                best[k] = min(best.get(k, ask), ask)
        into = {a[2]: a[3] for a in asks if best[a[2]] == best[a[3]] == a}
        if not into:
            return {r[0]: r[1] for r in rows}
        rows = [(r[0], into.get(r[1], r[1]), *r[2:]) for r in rows]
        records = describe(rows)


def test_small_groups_are_taken_in(spark):
    rows = sky(11, 200, 40)
    got = {r["id"]: r["grp"] for r in M.absorb(spark.createDataFrame(rows, KIND).repartition(3), least=5, cap=14).collect()}
    assert got == brute_absorb(rows, 5, 14)
    sizes = Counter(got.values())
    assert max(sizes.values()) <= 14
    assert len(sizes) < 40


def test_coverage_batches_are_the_fold_of_each_group(spark):
    from lumenfold.operators import grouping, kernels

    rng = random.Random(4)
    rows = [(g, i, [rng.randrange(12) for _ in range(rng.randrange(4))]) for g, n in (("a", 300), ("b", 3), ("c", 31), (None, 17)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, id long, cells array<int>").repartition(3)
    got = {(r["g"], r["id"]): r["batch"] for r in grouping.coverage_batches(df, "g", "id", "cells", total=12, least=4, target=9, share=0.7).collect()}
    want = {}
    for g in ("a", "b", "c", None):
        own = sorted((i, set(c)) for h, i, c in rows if h == g)
        want |= {(g, i): b for (i, _), b in zip(own, kernels.coverage_batches([c for _, c in own], 12, 4, 9, 0.7), strict=True)}
    assert got == want
    assert max(got.values()) > 20
