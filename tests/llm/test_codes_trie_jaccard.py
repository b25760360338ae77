"""Vector codes, the prefix trie and the Jaccard join against brute force, on fixtures with nulls, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import codes, jaccard, trie

VECTORS = "vec_id long, embedding array<double>, label int, code string, error long"
TURNS = "conv_id long, turn long, role string, text string, d long, owner string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lloyd(rows, parts, entries, rounds, scale):
    """(id, label, codes, error) and the books, in plain Python."""
    fine = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = max((len(v) for _, v, _ in fine), default=0)
    width = -(-dims // parts)
    floor = lambda x: int(np.floor(scale * x)) if np.isfinite(scale * x) else scale * int(x)
    ints = [[floor(x) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in fine]
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in ints]
    first = sorted(range(len(fine)), key=lambda k: (fine[k][0] is None, fine[k][0] or 0, fine[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (apart(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for v in cut:
                held[nearest(v[p], books[p])].append(v[p])
            for e, vs in held.items():
                books[p][e] = tuple(sum(c) // len(vs) for c in zip(*vs, strict=True))
    out = []
    for (i, _, g), v in zip(fine, cut, strict=True):
        found = [nearest(v[p], books[p]) for p in range(parts)]
        out.append((i, g, found, sum(apart(v[p], books[p][e]) for p, e in enumerate(found))))
    return out, books


def vectors(seed, n=120, dims=8):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(0, 1, dims), 2)], int(i % 3)) for i in rng.permutation(n)]
    rows += [(n, None, 1), (n + 1, [1.0] * (dims - 1) + [None], 1), (n + 2, [float("nan")] * dims, 1), (n + 3, [float("inf")] * dims, 0)]
    rows += [rows[3], rows[3], (None, rows[4][1], None), (5, [0.0] * dims, None), (n + 4, rows[7][1], None), (n + 5, [0.5] * (dims - 3), 2)]
    return rows


@pytest.mark.parametrize("huge", [False, True])
def test_codes_follow_plain_rounds(spark, huge):
    rows = vectors(3) + ([(900, [1e30] * 8, 7), (901, [-1e300] * 8, 7), (902, [1e30] * 8, 8)] if huge else [])
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(3)
    want, books = lloyd(rows, 4, 9, 3, 256)
    got = codes.report(df, parts=4, entries=9, rounds=3).collect()
    label = defaultdict(int)
    for _, g, _, e in want:
        label[g] += min(e, codes.LONGEST)
    key = lambda r: (str(r[0]), *map(str, r[1:4]))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    expect = [(i, "".join(f"{c:02x}" for c in found), min(e, codes.LONGEST), min(label[g], codes.LONGEST), digest) for i, g, found, e in want]
    assert sorted(map(tuple, got), key=key) == sorted(expect, key=key)


def test_bounds_spare_scans_and_never_a_tie(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(-40, 40, (4000, 4))
    books = x[:16].copy()
    state, moved, scanned = None, None, []
    plain = codes._scan
    monkeypatch.setattr(codes, "_scan", lambda v, b: (scanned.append(len(v)), plain(v, b))[1])
    for _ in range(6):
        state = codes._assign(x, books, state, moved)
        d = ((x[:, None] - books[None]) ** 2).sum(2)
        assert (state[0] == d.argmin(1)).all()
        new = np.array([x[state[0] == e].sum(0) // max(1, (state[0] == e).sum()) if (state[0] == e).any() else books[e] for e in range(16)])
        moved = codes._moves(books[None], new[None])[0]
        books = new
    assert scanned[0] == 4000
    assert sum(scanned[3:]) < 4000 * len(scanned[3:]) * 0.9


def test_codes_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert codes.report(empty).count() == 0
    assert codes.report(spark.createDataFrame([(1, None, 1, "", 0)], VECTORS)).count() == 0
    one = codes.report(spark.createDataFrame([(1, [], 1, "", 0)], VECTORS)).collect()
    assert [(r.vec_id, r.code, r.error) for r in one] == [(1, "00" * 16, 0)]


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    memo = {}

    def sums(p):
        below = [memo[k] for k in kids[p]]
        own_saved = (len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        memo[p] = (sum(b[0] for b in below) or 1, own_saved + sum(b[1] for b in below))

    for p in sorted(members, key=len, reverse=True):
        sums(p)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(rebuilt[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *memo[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def turns(seed):
    rng = random.Random(seed)
    say = lambda: " ".join(rng.choice("abc") for _ in range(rng.randrange(4)))
    rows = []
    for c in rng.sample(range(-30, 200), 70):
        for t in range(rng.randrange(1, 8)):
            rows.append((c, t, rng.choice(["user", "assistant"]), "same" if rng.random() < 0.6 else say()))
    rows += [(300, None, None, None), (300, None, "user", "x"), (300, 1, "user", None), (300, 1, "user", "b"), (300, 1, "assistant", "a"), (None, 1, "user", "lost")]
    rows += [(320, 0, "user", "only")] * 3 + [(321, 0, "user", "only")]
    rows += [(c, t, "user", f"hot {t}") for c in range(400, 460) for t in range(5)]
    rows += [(500, t, "user", f"long {t % 7}") for t in range(300)] + [(501, t, "user", f"long {t % 7}") for t in range(200)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [4096, 16])
def test_trie_against_all_prefixes(spark, chunk, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    monkeypatch.setattr(trie, "PIECE", 20)
    rows = turns(chunk)
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], TURNS).repartition(5)
    assert sorted(map(tuple, trie.trie(df).collect()), key=str) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert trie.trie(spark.createDataFrame([(None, 1, "user", "x", 0, "")], TURNS)).count() == 0


def brute_join(rows, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            smallest[find(i)] = min(d, smallest.get(find(i), d))
    return sorted((str(d), len(s), str(smallest.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(seed):
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = []
    for _ in range(10):
        base = words(rng.choice([6, 8, 9, 12, 14, 18, 25, 46, 60, 200]))
        for _ in range(rng.choice([3, 10, 40])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                t[rng.randrange(len(t))] = f"y{rng.randrange(6)}"
            t = t[: len(t) - rng.randrange(3)] if rng.random() < 0.3 else t
            texts.append(" ".join(t + [f"z{rng.randrange(3)}"] * (rng.random() < 0.3)))
    shared = " ".join(words(30))
    texts += [" ".join(words(rng.choice([5, 20, 100]))) + " " + shared for _ in range(40)]
    texts += [" ".join(words(5000)), None, "", " \n\t", texts[7].upper()]
    rows = list(enumerate(texts)) + [(5, texts[5]), (5, texts[5]), (None, texts[0]), (None, "alone")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("boundary", "block"), [(None, 4096), (0, 4096), (14, 7)])
def test_jaccard_join_loses_no_link(spark, boundary, block, monkeypatch):
    rows = near_copies(block)
    if boundary is not None:
        plan = jaccard.plan
        monkeypatch.setattr(jaccard, "plan", lambda *a: (*plan(*a)[:2], boundary))
    monkeypatch.setattr(jaccard, "BLOCK", block)
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], "doc_id long, text string, n int, node string").repartition(5)
    got = sorted((str(r[0]), r[1], str(r[2])) for r in jaccard.join(df).collect())
    assert got == brute_join(rows)


def test_jaccard_join_of_a_group_under_the_threshold(spark):
    """Copies that differ from each other in two places are mostly at 0.6 to 0.8; those that differ in one place link."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(300):
        t = list(base)
        t[rng.randrange(50)] = f"x{i}"
        rows.append((i, " ".join(t)))
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in found.collect()) == brute_join(rows)


def test_lists_leave_out_what_a_sample_of_few_texts_misses(spark, monkeypatch):
    """Phrases of a fiftieth of all texts are frequent, however few texts the boundary's sample has."""
    monkeypatch.setattr(jaccard, "SAMPLE", 32)
    rng = random.Random(11)
    phrases = [" ".join(f"p{g}q{k}" for k in range(12)) for g in range(50)]
    rows = [(i, " ".join(f"u{rng.randrange(10**9)}" for _ in range(60)) + " " + phrases[i % 50]) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    how = jaccard.plan(df, "text", 5, 80)
    lists = jaccard.members(jaccard.sketches(df, how, "doc_id", "text", 5, 80), how[2], 80)
    assert lists.where("scan").count() < 200


def test_places_decide_in_a_list():
    n, one, late = (np.array([x]) for x in (100, 11, 12))
    assert jaccard._compatible(n, one, n, one, 0, 80) and not jaccard._compatible(n, one, n, late, 0, 80) and not jaccard._compatible(n - 20, one, n, one - 11, 0, 80)


def test_boundary_follows_cost(spark):
    """Small sets whose shingles are rare are cheaper by lists, those that share much by subsets."""
    rare = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("id")) for k in range(16)]).alias("text"))
    alike = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.lit(f"w{k}") for k in range(12)], F.col("id")).alias("text"))
    assert jaccard.plan(rare, "text", 5, 80)[2] < 9 <= jaccard.plan(alike.unionByName(rare), "text", 5, 80)[2]


def test_jaccard_join_of_nothing(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    none = jaccard.join(spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, none)) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]
