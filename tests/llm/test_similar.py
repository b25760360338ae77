"""Near copies by five-word shingles: against brute force, in large groups and through chains."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from lumenfold.llm import jaccard, similar

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def changed(rng, base, k):
    out = list(base)
    for i in rng.sample(range(len(out)), k):
        out[i] = f"x{rng.randrange(10**9)}"
    return out


def brute(rows, least=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            union = len(sets[i]) + len(sets[j]) - both
            if not union or both / union >= least:
                pairs.append((rows[j][0], rows[i][0]))
                root[find(i)] = find(j)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    return pairs, {i: min(g) for g in groups.values() for i in g}


def corpus():
    rng = random.Random(7)
    texts = []
    for k in range(60):
        base = words(rng, 300)
        texts += [" ".join(base)] + [" ".join(changed(rng, base, c)) for c in (1, 2, 3, 6, 9)[: 1 + k % 5]]
    base = words(rng, 200)
    texts += [" ".join(changed(rng, base, 2)) for _ in range(40)]
    chain = words(rng, 200)
    for _ in range(12):  # neighbours are alike, the ends aren't
        chain = changed(rng, chain, 4)
        texts.append(" ".join(chain))
    texts += ["", "  ", "Only four words here", "only FOUR words  here", None]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_copies_against_brute_force(spark):
    rows = corpus()
    pairs, comp = brute(rows)
    got = {r["doc_id"]: r["component_id"] for r in similar.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(pairs) > 300 and got == comp


def test_stage_finds_similar_documents(spark):
    rng = random.Random(3)
    rows = []
    for k in range(20):
        base = words(rng, 300)
        for c, other in enumerate((base, changed(rng, base, 2), changed(rng, base, 5), changed(rng, base, 30))):
            rows.append((10 * k + c, " ".join(other), "en", "s", 1))
    _, comp = brute([r[:2] for r in rows])
    df = spark.createDataFrame(rows, COLUMNS)
    got = corpus_pipeline.drop_near_copies(spark, df, "").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(comp.values()))
    assert len(got) == 40


def test_bitmaps_never_part_what_links():
    rng = random.Random(1)
    told = 0
    for n, c in [(300, 6), (40, 1), (1500, 30), (12, 0), (300, 60), (40, 10)] * 40:
        base = words(rng, n)
        a, b = (jaccard.shingles(" ".join(t)) for t in (base, changed(rng, base, c)))
        shared = len(np.intersect1d(a, b))
        passes = jaccard.may_link(len(a), len(b), jaccard.parity(a), jaccard.parity(b), 80)
        assert passes or 100 * shared < 80 * (len(a) + len(b) - shared)
        told += not passes
    assert told > 60
