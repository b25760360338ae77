"""The stages and their order, on small tables with clashing columns, and the registered queries at the smallest scale."""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict

import pytest

import __spark_entry__
import corpus_pipeline
from lumenfold.llm import exact, queries, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near_groups(texts):
    """{id: smallest id reachable} by five-word shingles of Jaccard similarity 0.8 or more, pair by pair."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        union = len(sets[a]) + len(sets[b]) - both
        if not union or both / union >= 0.8:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(path := str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(path)
        kept[name] = docs
        if name != names[-1]:
            assert docs.columns == columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r["doc_id"] for r in kept[names[0]].collect()}
    assert sum(q == (i in left) for i, q in labels.items()) / len(labels) > 0.95
    texts = Counter(r["text"] for r in kept[names[1]].collect())
    assert max(texts.values()) == 1 and set(texts) == {r["text"] for r in kept[names[0]].collect()}
    near = near_groups({r["doc_id"]: r["text"] for r in kept[names[1]].collect()})
    distinct = kept[names[2]].collect()
    assert sorted(r["doc_id"] for r in distinct) == sorted(set(near.values())) and len(distinct) < len(near)
    mixed = Counter(r["doc_id"] for r in kept[names[3]].collect())
    size, source = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in distinct}, {r["doc_id"]: r["source"] for r in distinct}
    assert set(mixed) <= size.keys() and max(mixed.values()) <= 3
    have, taken = Counter(), Counter()
    for i, n in size.items():
        have[source[i]] += n
        taken[source[i]] += n * mixed[i]
    target = water_fill(have)
    assert all(abs(taken[s] - target[s]) <= max(n for i, n in size.items() if source[i] == s) / 2 + 1 for s in have)
    packed = kept[names[4]].collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == mixed
    bins = defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == list(itertools.accumulate((n for _, n in sorted(b)[:-1]), initial=0)) and sum(n for _, n in b) <= 2048
    assert len(bins) <= 1 + 1.02 * sum(r["length"] for r in packed) / 2048


def water_fill(have):
    """Targets by weights 1, 2, 3 in order of the sources, at most three times each, one clamp after another."""
    names = sorted(have, key=lambda s: (s is None, s or ""))
    weight, target, left, free = {s: 1 + i % 3 for i, s in enumerate(names)}, {}, sum(have.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * have[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 3 * have[s]
            left -= target[s]
            free.remove(s)
    return target


def test_stages_take_an_empty_table(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_exact_then_near_keeps_one_of_each_group(spark):
    rows = [(1, "a b c d e f g", "en", "s", 1), (2, "a b c d e f g", "en", "s", 1), (3, "A B c d e f g", "en", "s", 1), (4, "else", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in simhash.survivors(exact.survivors(df), shingle=5).collect()) == [2, 4]
