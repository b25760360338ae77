"""The training-data operators against brute force, on small fixtures with nulls, ties, repeats and clashing names."""

from __future__ import annotations

import itertools
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenfold.llm import exact, html, lm, mixing, packing, pii, quality, queries, records, simhash, topk
from lumenfold.llm.encoding import Encoder, encoder
from lumenfold.session import new_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BYTE, WORDS = (queries.tokenizer(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def documents(n=60):
    """Documents with nulls everywhere, empty and long texts, copies, near copies, repeated rows."""
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(vocabulary, k))
    rows = [(i, text(int(rng.integers(1, 120))), "en", f"src{i % 4}", 9) for i in range(n)]
    long = text(6000)
    rows += [(n, None, None, None, None), (n + 1, "", "en", "src1", 0), (n + 2, "  \n ", "de", None, 4), (n + 3, long, "en", "src0", 1), (n + 4, long + " end", "en", "src0", 1)]
    rows += [(n + 5, rows[3][1], "fr", "src3", 1), (n + 6, rows[3][1], "fr", "src9", 1), (n + 7, rows[3][1].upper(), "fr", "src9", 1)]
    rows += [rows[5], rows[5], (n + 8, "a", "en", "src2", 1), (n + 9, "a b", "en", "src2", 1), (n + 10, "Über ß naïve 漢字 <|endoftext|>  x", "en", "src2", 1), (None, "no id", "en", "src2", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_mixing_fills_and_samples(spark, docs):
    rows = documents()
    size = lambda t: len(WORD.findall(t or ""))
    total = Counter()
    for r in rows:
        total[r[3]] += size(r[1])
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(total.values())), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * total[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
            open_.remove(s)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r["size"] == size(r["text"]) and r["source_size"] == total[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= max(size(r[1]) for r in rows if r[3] == s) / 2 + 120
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.repeat(mixing.mix(docs)).count() == sum(r["copies"] for r in got)


def test_mixing_edges(spark, docs, empty):
    assert mixing.mix(empty).count() == 0
    clash = docs.withColumn("size", F.lit("x")).withColumn("target", F.lit(None).cast("string"))
    out = mixing.mix(clash)
    assert dict(out.dtypes)["size"] == "bigint" and out.count() == docs.count()
    nothing = spark.createDataFrame([(1, None, None, "a", None), (2, "", None, None, None)], DOCS)
    assert [r["taken"] for r in mixing.mix(nothing).collect()] == [0, 0]


def test_exact_groups_and_survivors(spark, docs, empty):
    rows = documents()
    by = defaultdict(list)
    for r in rows:
        by[r[1] or ""].append(r[0])
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in by.items()}
    got = exact.groups(docs).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        t = text[r["doc_id"]]
        assert r["keep_id"] == keep[t] and r["group_size"] == len(by[t])
        assert r["text_sha256"] == __import__("hashlib").sha256(t.encode()).hexdigest()
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter({r["text_sha256"]: 1 for r in got})
    kept = exact.survivors(docs).collect()
    assert sorted(r["text"] or "" for r in kept) == sorted(by)
    assert all(r["doc_id"] == keep[r["text"] or ""] for r in kept) and kept[0].asDict().keys() == {c.split(" ")[0] for c in DOCS.split(", ")}
    assert exact.groups(empty).count() == 0 and exact.survivors(empty).count() == 0
    clash = docs.withColumn("digest", F.lit(1)).withColumn("keep_id", F.lit(2))
    assert exact.survivors(clash).count() == len(by)


def brute_fingerprint(t, k=3):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(ids, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, docs, empty):
    rows = [r for r in documents() if r[0] is not None]
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows}
    comp = brute_components(fps)
    got = simhash.near_duplicates(docs.where("doc_id IS NOT NULL")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}" and r["component_id"] == comp[r["doc_id"]]
    stay = simhash.survivors(docs.where("doc_id IS NOT NULL")).collect()
    assert sorted(r["doc_id"] for r in stay) == sorted(set(comp.values()))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.survivors(empty).count() == 0
    assert simhash.near_duplicates(docs).count() == len(documents())


@pytest.mark.parametrize("seed", [1, 2])
def test_vantage_trees_lose_no_link(spark, monkeypatch, seed):
    """Random, clustered and chained fingerprints through several shards of both trees."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 700, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 700, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), False))) for b in base[:200]]
    cluster = [base[0] ^ np.uint64((1 << int(i)) | (1 << int(j))) for i, j in itertools.combinations(range(24), 2)]
    chain = list(itertools.accumulate(range(40), lambda v, k: v ^ (7 << (k % 20) * 3), initial=int(base[1])))
    fps = np.unique(np.array([*base, *near, *cluster, *chain], np.uint64))
    monkeypatch.setattr(simhash, "SHARD", 64)
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long").repartition(4)
    comp = {r["node"]: r["root"] for r in simhash.components(simhash.near_edges(df)).collect()}
    expected = brute_components({int(s): int(u) for s, u in zip(fps.view(np.int64), fps, strict=True)})
    assert {k: comp.get(k, k) for k in expected} == expected
    nodes = simhash.build(fps, 0, 32, 3)
    shards = sum(n[0] is None for n in nodes)
    visited = sum(len(h) + len(g) for _, h, g in simhash.route(nodes, fps))
    assert shards > 8 and len(fps) < visited < shards * len(fps) / 2


def test_large_shards_are_cut_again(spark, monkeypatch):
    """Trees of two levels and more give the same components and bounded shards; a dense cluster ends too."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 12_000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 12_000, dtype=np.uint64)
    near = base[:500] ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    dense = [base[0] ^ np.uint64((1 << int(i)) | (1 << int(j))) for i, j in itertools.combinations(range(40), 2)]
    fps = np.unique(np.array([*base, *near, *dense], np.uint64))
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long").repartition(4)
    roots = lambda: {r["node"]: r["root"] for r in simhash.components(simhash.near_edges(df)).collect()}
    want = roots()
    monkeypatch.setattr(simhash, "SAMPLE", 256)
    monkeypatch.setattr(simhash, "SHARD", 128)
    monkeypatch.setattr(simhash, "LARGE", 1024)
    seen, cut = [], simhash._cut_again
    monkeypatch.setattr(simhash, "_cut_again", lambda dealt, radius: (seen.append(dealt), cut(dealt, radius))[1])
    assert roots() == want and len(want) >= 1000
    largest = [d.groupBy("half", "shard").count().agg(F.max("count")).first()[0] for d in seen]
    copies = seen[-1].count() / len(fps)
    print("largest shards:", largest, "copies of a fingerprint:", copies)
    assert len(seen) > 1 and largest[-1] < 2 * 1024 < largest[0] and copies < 60


def test_fast_encoding_equals_the_library():
    for path in (BYTE, WORDS):
        enc = Encoder(path, 0)
        for r in documents() + [(0, t, None, None, None) for t in (" lead", "trail ", "a\nb", "a\n\nb", "a \n b", "tab\tx", "don't I'll", "x%%% é¡y", "É À", "\r\n", "a b", "A.B,c!! 12345")]:
            whole = enc.tokenizer.encode(r[1] or "", add_special_tokens=False).ids
            assert enc.ids(r[1]).tolist() == [*whole, 0], r[1]


def test_records_round_trip(spark, docs, empty, tmp_path):
    out = tmp_path.as_uri()
    manifest = records.write(docs, out, BYTE)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) for r in records.read(spark, out, manifest).collect())
    enc, start = encoder(BYTE), 0
    rows = sorted(documents(), key=lambda r: (r[0] is not None, r[0] or 0))
    for r, g in zip(rows, got, strict=True):
        ids = enc.ids(r[1]).astype("<u4")
        assert g == (r[0] is not None, r[0] or 0, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    one = manifest.first()
    order = list(range(one["records"]))[::-1]
    back = records.read_at(out, one["rec"], one["idx"], order)
    texts = {r[0]: r[1] for r in documents()}
    assert all(ids.tolist() == enc.ids(texts[k]).tolist() for k, ids in back) and len(back) == one["records"]
    data = bytearray(open(one["rec"], "rb").read())
    data[20] ^= 1
    open(one["rec"], "wb").write(data)
    with pytest.raises(ValueError, match="damaged"):
        records.read_at(out, one["rec"], one["idx"], [0])
    assert records.read(spark, out, records.write(empty, new_path(spark, "none"), BYTE)).count() == 0


def test_packing(spark, docs, empty):
    enc = encoder(WORDS)
    expected = Counter()
    for r in documents():
        ids = enc.ids(r[1]).astype("<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            expected[r[0], k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())] += 1
    got = packing.pack(docs, WORDS).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.pack(empty, WORDS).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_bins_are_valid_and_few(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, 400) if seed % 2 else rng.choice([34, 40, 51, 67, 10, 3, 100], 500)
    counts = Counter(int(n) for n in lengths)
    bins, used = defaultdict(list), Counter()
    for n, first, pieces, start, to_bin, offset in packing.plan_bins(counts, 100):
        assert first == used[n]
        used[n] += pieces
        for k in range(pieces):
            bins[start + k // to_bin].append((offset + k % to_bin * n, n))
    assert used == counts
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 100 and sum(3 * n > 100 for _, n in b) <= 2
    best = first_fit_decreasing(lengths, 100)
    assert len(bins) <= best * 1.03 + 1


def first_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(map(int, lengths), reverse=True):
        k = next((i for i, g in enumerate(gaps) if g >= n), None)
        if k is None:
            gaps.append(capacity - n)
        else:
            gaps[k] -= n
    return len(gaps)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=20)], i % 3) for i in range(400)]
    vectors += [(400 + i, vectors[0][1], 0) for i in range(30)]  # ties
    vectors += [(500, None, 0), (550, [float("nan")] * 20, 0), (600, [float("inf")] + [0.0] * 19, 0), (650, [None] * 20, 0), (700, [1.0, 2.0], 0), (701, [3.0, 4.0], 0), (None, [1.0] * 20, 0), (750, [], 0), vectors[5], vectors[50]]
    vectors += [(800, [1e5] * 20, 0), (801, [-3e38] * 20, 0), (802, [3e38] * 20, 0), (850, [2e6, -1e6] * 10, 0)]  # past 2**53, past a long
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("clash")).repartition(5)
    got = defaultdict(list)
    for r in sorted(topk.top_k(df, F.col("vec_id") % 50 == 0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    long = lambda x: max(-(2**63), min(2**63 - 1, x))
    use = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q in {i for i, _ in use if i % 50 == 0}:
        mine = next(v for i, v in use if i == q)
        scores = sorted(((-long(sum(a * b for a, b in zip(mine, v, strict=True))), i) for i, v in use if i != q and len(v) == len(mine)))[:5]
        assert got.pop(q, []) == [(i, -s) for s, i in scores]
    assert not got
    none = spark.createDataFrame([], df.schema)
    assert topk.top_k(none, F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_in_several_parts_and_without_a_sample(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").repartition(3)
    order = lambda d: sorted(map(tuple, d.collect()))
    want = order(topk.top_k(df, F.col("vec_id") % 50 == 0))
    monkeypatch.setattr(topk, "QUERY_BYTES", 2000)
    monkeypatch.setattr(topk, "SEED", 3)
    assert order(topk.top_k(df, F.col("vec_id") % 50 == 0)) == want and len(want) == 50


def test_top_k_compacts_before_the_last_block(spark):
    """Of the candidates that enter the fifth of eight blocks, well under half are left on the driver's table."""
    rows = [(r["id"], r["v"]) for r in topk.quantized(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), "vec_id", "embedding", 256).collect()]
    ids, vectors = topk._grouped(rows)[64]
    asked = {64: (ids[ids % 50 == 0], vectors[ids % 50 == 0])}
    kth, some, passed = topk.first_pass(asked, topk._grouped(rows[: topk.SEED]), 5)[64], topk.Candidates(vectors, ids), np.zeros(9)
    for own, q, bound in zip(*asked[64], kth, strict=True):
        some.best(q, int(own), 5, bound, passed)
    share = passed / passed[0]
    print("alive by block:", share.round(3))
    assert share[4] < 0.5 and share[7] < 0.05 and (np.diff(share) <= 0).all()


PAGE = (
    '<!DOCTYPE html><html><head><title>T&amp;t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul>{links}</ul></nav><div class="ad">buy</div>'
    '<article><header>by x</header><h1>Head &amp; {n}</h1>{body}<section class="comments"><p>me too</p></section></article><aside>side</aside><footer>&copy; f</footer></body></html>'
)


def page(n, paragraphs, links=2):
    return PAGE.format(n=n, links="".join(f"<li><a href='/{i}'>link{i}</a></li>" for i in range(links)), body="".join(f"<p>par <b>{i}</b><br>of\n {n}" + "</p>" * (i % 2) for i in range(paragraphs)))


def test_html_main_text(spark):
    pages = [(i, f"https://h{i % 2}.example/x/{i}", page(i, i % 4, i % 3)) for i in range(12)]
    pages += [(20, None, None), (21, "no host", ""), (22, "https://h0.example/", "<p>only < text &lt;b&gt; <!-- c --> here<div hidden>no</div><p>two"), (23, "https://h0.example/", "<script>never closed <p>x"), pages[3], (None, "https://h1.example/", "<article><p>A</article>tail")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html.main_text(df).collect()]
    expected = []
    for i, _, h in pages:
        if i is None:
            t = "A"
        elif i < 20:
            t = "\n".join([f"Head & {i}", *(f"par {k} of {i}" for k in range(i % 4))])
        else:
            t = {22: "only < text <b> here\ntwo"}.get(i, "")
        expected.append((i, t, len(t)))
    order = lambda x: sorted(x, key=str)
    assert order(got) == order(expected)
    assert html.main_text(spark.createDataFrame([], df.schema)).count() == 0


def test_wrappers_are_union_free():
    streams = [html.tokens(page(i, i % 4, i % 3)) for i in range(12)]
    w = streams[0]
    for t in streams[1:]:
        w = html.align(w, t)
    text = html.expression(w, 12)
    assert "(<p> # </p>)+" in text and ")?" in text and "|" not in text
    halves = [html.tokens(page(i, i % 4, i % 3)) for i in range(12)]
    left, right = halves[0], halves[5]
    for t in halves[1:5]:
        left = html.align(left, t)
    for t in halves[6:]:
        right = html.align(right, t)
    assert html.expression(html.align(left, right), 12) == text  # in a tree as one after another


def plain_page(i):
    """No element has a telling name: what is template shows on the host's pages alone."""
    links = "".join(f"<div class='z'><a href='/{k}'>go{i}x{k}</a></div>" for k in range(4))
    body = "".join(f"<p>Words {i} of {k}, told <i>once</i>.</p>" for k in range(1 + i % 4))
    return f"<html><body><div class='x1'>Get our daily letter</div><div>{links}</div><div class='x2 has-sidebar'><h1>Title {i}</h1>{body}<p>All rights are ours.</p></div></body></html>"


def test_only_the_wrapper_tells_template_from_text(spark, monkeypatch):
    pages = [(i, "https://plain.example/a", plain_page(i)) for i in range(10)]
    pages += [(20 + i, f"https://lone{i}.example/", "<p>Get our daily letter</p><p>Own text</p>") for i in range(4)]
    pages += [(30 + i, "https://copies.example/", "<div><p>One text</p><p>in four copies</p></div>") for i in range(4)]
    pages += [(40 + i, "https://form.example/", f"<form id='aspnet'><div class='search-result'><h1>Found {i}</h1><p>A long text {i} in a form around the page</p></div></form>") for i in range(3)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    want = {i: "\n".join([f"Title {i}", *(f"Words {i} of {k}, told once." for k in range(1 + i % 4))]) for i in range(10)}
    want |= {20 + i: "Get our daily letter\nOwn text" for i in range(4)} | {30 + i: "One text\nin four copies" for i in range(4)}
    want |= {40 + i: f"Found {i}\nA long text {i} in a form around the page" for i in range(3)}
    assert {r["page_id"]: r["text"] for r in html.main_text(df).collect()} == want
    monkeypatch.setattr(html, "BROADCAST_BYTES", -1)  # the join instead of the broadcast
    assert {r["page_id"]: r["text"] for r in html.main_text(df).collect()} == want
    bare = {i: html.extract(h, {}) for i, _, h in pages}
    assert all("Get our daily letter" in bare[i] for i in range(10)) and {i for i in bare if bare[i] != want[i]} == {*range(10), 40, 41, 42}


def test_names_match_whole_words_and_inline_elements_count():
    text = lambda inner: html.extract(inner, {})
    for kept in ("overflow-hidden", "md:block hidden", "content has-sidebar", "search-result", "legal-guide", "header-image"):
        assert text(f'<div class="{kept}"><p>stays</p></div>') == "stays", kept
    for gone in ("ad", "site-footer", "ad-slot", "hidden", "main_nav", "cookie-notice"):
        assert text(f'<div class="{gone}"><p>goes</p></div>') == "", gone
    assert text('<article data-hidden="false"><p>a <span class="ad">buy</span> b<a class="share">tell</a></p></article>') == "a b"
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>y") == "deep\ny"


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(5)
    good = lambda: ". ".join(" ".join("".join(rng.choice(list("aeioutnrs"), rng.integers(2, 8))) for _ in range(12)).capitalize() for _ in range(6))
    bad = [lambda: " | ".join(good().split()[:30]), lambda: good().upper().replace(" ", "!! "), lambda: " ".join(["Buy"] * 60), lambda: " ".join(w + "%%%" for w in good().split())]
    rows = [(i, good() if i % 3 else bad[i % 4](), "en", f"s{i % 5}", 0) for i in range(600)]
    df = spark.createDataFrame([*rows, (900, None, None, None, None), (901, "", None, "s0", 0), rows[1]], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0), (9999, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels).collect()
    assert len(got) == 603
    held = [r for r in got if r["doc_id"] is not None and 300 <= r["doc_id"] < 600]
    assert sum(r["keep"] == (r["doc_id"] % 3 > 0) for r in held) / len(held) > 0.97
    assert not any(r["keep"] for r in got if r["doc_id"] in (900, 901))
    assert all(0 < r["path_posterior"] < 1 and 0 <= r["posterior"] <= 1 for r in got)
    assert quality.classify(empty, labels).count() == 0
    assert quality.classify(docs, labels.where("quality = 7")).count() == len(documents())
    clash = df.withColumn("keep", F.lit("x")).withColumn("host", F.lit(1))
    assert dict(quality.classify(clash, labels).dtypes)["keep"] == "boolean"


def test_small_sites_shrink_more(spark):
    rows = [("big", "a", 0.9)] * 400 + [("small", "a", 0.1)] * 2 + [("other", "b", 0.5)] * 100 + [(None, None, 0.2)]
    table, mean = quality.sites(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {r["s_host"]: r for r in table.collect()}
    assert abs(got["big"]["host_posterior"] - 0.9) < abs(got["small"]["host_posterior"] - 0.1)
    assert 0.1 < got["small"]["path_posterior"] < mean and None in got


def follows(words):
    return [None, *words[:-1]] if words else []


def brute_losses(rows, target):
    """{row number: (words, target loss, background loss)} from counts of words and pairs as they are."""
    split = [WORD.findall((r[1] or "").lower()) for r in rows]
    count = {True: (Counter(), Counter()), False: (Counter(), Counter())}
    for r, words in zip(rows, split, strict=True):
        context, pair = count[r[0] in target]
        context.update(follows(words))
        pair.update(zip(follows(words), words, strict=True))
    size = {k: sum(len(r[1] or "") for r in rows if (r[0] in target) == k) for k in (True, False)}
    scale = {k: min(1, size[not k] / size[k]) if all(size.values()) else 1 for k in size}
    out = {}
    for i, (r, words) in enumerate(zip(rows, split, strict=True)):
        own = Counter(follows(words)), Counter(zip(follows(words), words, strict=True))
        loss = {}
        for k in (True, False):
            minus = (r[0] in target) == k
            c = lambda which, x: (count[k][which][x] - minus * own[which][x]) * scale[k]  # noqa: B023, E731
            loss[k] = sum(-math.log((c(1, (p, w)) + lm.CONTEXT / lm.VOCABULARY) / (c(0, p) + lm.CONTEXT)) for p, w in zip(follows(words), words, strict=True))
        out[i] = len(words), loss[True] / max(1, len(words)), loss[False] / max(1, len(words))
    return out


@pytest.mark.parametrize("shared", [True, False])
def test_lm_against_brute_force(spark, docs, empty, monkeypatch, shared):
    """With and without n-grams that are counted apart, over many chunks and blocks; tasks get these sizes by value."""
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(lm, "BLOCK_CHARS", 3000)
    monkeypatch.setattr(lm, "SAMPLE", 400 if shared else 10**9)
    monkeypatch.setattr(lm, "BROADCAST_TARGET", 10**6 if shared else -1)
    clash = docs.withColumn("score", F.lit("x")).withColumn("n_tokens", F.lit("x"))
    got = lm.score(clash, labels).collect()
    rows = documents()
    want = brute_losses(rows, {i for i in range(40) if i % 2})
    expected = sorted((r[0] is not None, r[0] or 0, *want[i]) for i, r in enumerate(rows))
    assert len(got) == len(rows)
    for g, w in zip(sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["target_loss"] or 0.0, r["background_loss"] or 0.0) for r in got), expected, strict=True):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], rel=1e-5)
    assert all((r["score"] is None) == (r["n_tokens"] == 0) and (r["score"] is None or r["score"] == r["target_loss"] - r["background_loss"]) for r in got)
    assert lm.score(empty, labels).count() == 0
    assert all(math.isfinite(r["score"]) for r in lm.score(docs, labels.where("quality = 7")).collect() if r["n_tokens"])


def test_lm_packs_and_unpacks():
    rng = np.random.default_rng(1)
    gram = np.sort(rng.integers(0, 2**63, 50, dtype=np.uint64).repeat(rng.integers(1, 4, 50)))
    doc, own = rng.integers(0, 60_000, len(gram)), rng.integers(1, 9, len(gram))
    for count in (own, own * 100_000):
        back = lm.unpack(lm.pack(gram, doc, count))
        assert [x.tolist() for x in back] == [gram.tolist(), doc.tolist(), count.tolist()]
    assert lm.grams("a b a b")[1].tolist() == np.unique(lm.grams("A b\ta  b")[1]).tolist() and lm.grams(" ")[0] == 0


KEY = b"test"
PII = "Mail Anna.Smith@mail7.example.com or ANNA.SMITH@MAIL7.EXAMPLE.COM, call +1 (974) 555-3436 or +1 974 555 3436, card 4111 1111 1111 1111 / 4111111111111111, host 129.38.82.176, ssn 123-45-6789, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\". Mrs. Maria Weber met Herr Peter Klein. Mrs. Maria Weber left."


def test_pii_surrogates():
    new, spans = pii.rewrite(PII, KEY, {})
    assert Counter(k for k, _, _ in spans) == {"email": 2, "phone": 2, "card": 2, "ip": 1, "ssn": 1, "secret": 1, "name": 3}
    for old in ("Smith", "974", "4111", "129.38", "6789", "04dbe", "Weber", "Klein"):
        assert old not in new and old.upper() not in new.upper()
    value = defaultdict(list)
    for k, a, b in spans:
        value[k].append(new[a:b])
    assert value["email"][0].lower() == value["email"][1].lower() and value["email"][1].isupper()
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(value["phone"][0]) == digits(value["phone"][1]) and value["phone"][0].startswith("+1 (") and digits(value["card"][0]) == digits(value["card"][1])
    assert pii.luhn(digits(value["card"][0])) and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", value["card"][0]) and re.fullmatch(r"[0-9a-f]{40}", value["secret"][0])
    assert value["name"][0] == value["name"][2] and value["name"][0].split()[0] in pii.GIVEN["f", "LATIN"] and value["name"][1].split()[0] in pii.GIVEN["m", "LATIN"]
    assert all(0 <= int(x) <= 255 for x in value["ip"][0].split("."))
    cyrillic, spans = pii.rewrite("Mr. Иван Петров", KEY, {})
    assert cyrillic.split()[1] in pii.GIVEN["m", "CYRILLIC"] and all(pii.script(c) == "CYRILLIC" for c in cyrillic.split()[2])
    assert pii.rewrite("Nothing here, 3 of 12.", KEY, {}) == ("Nothing here, 3 of 12.", [])


def brute_resolve(entities, key=KEY):
    """{(kind, canon): (attempt, surrogate)}: the first by (attempt, name) keeps a surrogate that is no entity."""
    attempt = dict.fromkeys(entities, 0)
    while True:
        made = {e: (e[0], pii.core(e[0], entities[e], e[1], attempt[e], key)) for e in entities}
        first = {}
        for e in sorted(entities, key=lambda e: (attempt[e], e[1])):
            first.setdefault(made[e], e)
        again = [e for e in entities if first[made[e]] != e or made[e] in entities]
        if not again:
            return {e: (attempt[e], made[e][1]) for e in entities}
        for e in again:
            attempt[e] += 1


PERSONS = [f"Mr. {chr(65 + i)} said so. Then Dr {chr(65 + i)} left." for i in range(26)]
PERSONS += ["Mrs. Maria Weber met Dr. Maria Weber. Mr. Maria Weber.", "Ms Jordan Lee came.", "Dr. Jordan Lee went.", "Mr. Robin Hay", "Mrs. Robin Hay", "Jennifer Lopez and Mohammed Ali", 'password: 123456 and password: "dead66beef"']


def test_pii_distinct_over_the_corpus(spark, docs, empty, monkeypatch):
    """Every initial is taken, so second and wider attempts must reach the texts, on both ways."""
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(PERSONS)]
    rows += [(100 + i, f"ssn {100 + i:03d}-{10 + i}-{1000 + i} and {100 + i:03d}-{10 + i}-{1000 + i}", "en", "s", 0) for i in range(30)] + [(200, None, None, None, None), (201, "", None, None, 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("entities", F.lit(1)).repartition(3)
    known = {(r["kind"], r["canon"]): (r["gender"], r["attempt"], r["made"]) for r in pii.resolve(df, KEY).collect()}
    genders = {e: v[0] for e, v in known.items()}
    assert {e: v[1:] for e, v in known.items()} == brute_resolve(genders)
    assert len({(e[0], v[2]) for e, v in known.items()}) == len(known) and not {(e[0], v[2]) for e, v in known.items()} & known.keys()
    assert genders["name", "maria weber"] == genders["name", "jordan lee"] == genders["name", "robin hay"] == "f"
    plain = {r["doc_id"]: (r["text"], r["n_entities"]) for r in pii.pseudonymize(df, KEY).collect()}
    monkeypatch.setattr(pii, "BROADCAST_RETRIES", -1)
    joined = {r["doc_id"]: (r["text"], r["n_entities"]) for r in pii.pseudonymize(df, KEY).collect()}
    assert plain == joined and plain[200] == (None, 0) and plain[201] == ("", 0)
    initials = [re.fullmatch(r"Mr\. (\w+) said so\. Then Dr (\w+) left\.", plain[i][0]).groups() for i in range(26)]
    assert all(a == b for a, b in initials) and len({a for a, _ in initials}) == 26
    assert all(a.lower() == known["name", chr(97 + i)][2] for i, (a, _) in enumerate(initials)) and max(v[1] for v in known.values()) >= pii.WIDEN
    one = re.fullmatch(r"Mrs\. (.+) met Dr\. (.+)\. Mr\. (.+)\.", plain[26][0]).groups()
    assert len(set(one)) == 1 and one[0].split()[0] in pii.GIVEN["f", "LATIN"]
    lee = [plain[27][0].removeprefix("Ms ").removesuffix(" came."), plain[28][0].removeprefix("Dr. ").removesuffix(" went.")]
    assert lee[0] == lee[1] and lee[0].split()[0] in pii.GIVEN["f", "LATIN"] and plain[29][0][4:] == plain[30][0][5:]
    assert plain[31][1] == 2 and "Lopez" not in plain[31][0] and "Ali" not in plain[31][0]
    assert re.fullmatch(r'password: \d{6} and password: "[0-9a-f]{10}"', plain[32][0])
    found = [re.findall(r"\d{3}-\d{2}-\d{4}", plain[100 + i][0]) for i in range(30)]
    assert all(a == b for a, b in found) and len({a for a, _ in found}) == 30
    assert pii.pseudonymize(empty, KEY).count() == 0 and pii.pseudonymize(docs, KEY).count() == len(documents())


def test_pii_whole_texts_against_brute_force(spark):
    """The query's texts equal those rewritten one by one with the resolved entities."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    genders = {}
    for t in texts.values():
        for a, b, kind, detail in pii.find(t or ""):
            e = kind, pii.canonical(kind, t[a:b])
            genders[e] = min(detail, genders.get(e, detail))
    known = {e: (attempt, genders[e]) for e, (attempt, _) in brute_resolve(genders, queries.SURROGATE_KEY).items()}
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymize(df, queries.SURROGATE_KEY).collect()}
    assert got == {i: None if t is None else pii.rewrite(t, queries.SURROGATE_KEY, known)[0] for i, t in texts.items()} and len(genders) > 10


def extracted(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    return {r["page_id"]: r["text"] for r in html.main_text(df).collect()}


def test_copies_of_a_page_make_no_template(spark):
    story = "<div class='content'><h1>One story</h1><p>Told three times.</p></div>"
    pages = [(i, "https://six.example/", story) for i in range(3)] + [(3 + i, "https://six.example/", f"<div class='content'><h1>Story {i}</h1><p>Told once, {i}.</p></div>") for i in range(3)]
    got = extracted(spark, pages)
    assert got == {i: "One story\nTold three times." for i in range(3)} | {3 + i: f"Story {i}\nTold once, {i}." for i in range(3)}


def test_what_an_article_repeats_stays(spark):
    pages = [(i, "https://a.example/", f"<article><h1>Title {i}</h1><p>By Jane Doe</p><h2>Abstract</h2><p>Words {i}.</p></article>") for i in range(6)]
    assert extracted(spark, pages) == {i: f"Title {i}\nBy Jane Doe\nAbstract\nWords {i}." for i in range(6)}
    pages = [(i, "https://b.example/", f"<div><h1>Dish {i}</h1><p>{'Recipe. Serves four people.' if i < 4 else f'Serves {i}.'}</p><p>Take {i} eggs.</p><p>Stir {i} times.</p></div>") for i in range(6)]
    got = extracted(spark, pages)
    assert all("Serves" in t for t in got.values())


def test_a_list_of_own_links_is_no_menu(spark):
    titles = lambda i: "".join(f"<li><a href='/paper/{i}-{k}'>Paper {k} of {i}</a></li>" for k in range(5))
    menu = "".join(f"<div class='z'><a href='/{k}'>Go {k}</a></div>" for k in range(4))
    pages = [(i, "https://papers.example/", f"<div>{menu}</div><div><h1>Issue {i}</h1><ul>{titles(i)}</ul></div>") for i in range(5)]
    assert extracted(spark, pages) == {i: "\n".join([f"Issue {i}", *(f"Paper {k} of {i}" for k in range(5))]) for i in range(5)}


def test_a_text_of_half_the_pages_is_counted_among_many(spark):
    note = lambda i: "Get our letter" if i % 2 else f"Note of page {i}"
    pages = [(i, "https://many.example/", f"<div><h1>Title {i}</h1><p>Own words {i}</p><div class='z'>{note(i)}</div></div>") for i in range(200)]
    assert extracted(spark, pages) == {i: f"Title {i}\nOwn words {i}" + ("" if i % 2 else f"\nNote of page {i}") for i in range(200)}


def test_a_menu_of_many_links_is_counted_whole(spark):
    page = lambda i: "<div><h1>Title {0}</h1><p>Own words {0}</p></div><ul class='z'>{1}</ul>".format(i, "".join(f"<li><a href='/{k}'>Go to {k} from {i}</a></li>" for k in range(i % 2, 200, 2)))
    assert extracted(spark, [(i, "https://menu.example/", page(i)) for i in range(6)]) == {i: f"Title {i}\nOwn words {i}" for i in range(6)}


def test_ids_of_pages_leave_the_wrapper_small(spark):
    one = lambda i: f"<body class='postid-{i}'><div class='box'>Get our letter today</div><div id='post-{i}' class='post-{i} entry'><h1>Title {i}</h1><p>Own words {i}</p></div></body>"
    size = {}
    for n in (20, 200):
        df = spark.createDataFrame([(i, "https://blog.example/", one(i)) for i in range(n)], "page_id long, url string, html string")
        size[n] = max(len(r["wrapper"]) for r in html.wrappers(df).collect())
    assert size[200] < size[20] * 4
    assert extracted(spark, [(i, "https://blog.example/", one(i)) for i in range(40)]) == {i: f"Title {i}\nOwn words {i}" for i in range(40)}


def test_parts_of_a_name_are_known_again(spark):
    texts = ["Maria Weber's car", "Maria Weber left", "Dr. Weber spoke", "Dr. J. Weber spoke", "Mr. R. J. Weber and Maria Klein", "call 5552345678 now", "at 2001:db8::ff00:42:8329 or 2001:0db8:0000:0000:0000:ff00:0042:8329", "std::vector and a::b at 12:30:45, order 1234567890"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in pii.pseudonymize(df, b"k").orderBy("doc_id").collect()]
    given, surname = got[1].split()[:2]
    assert {given, surname}.isdisjoint({"Maria", "Weber"})
    assert got[0] == f"{given} {surname}'s car"
    assert got[2] == f"Dr. {surname} spoke"
    initial = re.fullmatch(rf"Dr\. (\w)\. {surname} spoke", got[3])
    assert initial
    assert re.fullmatch(rf"Mr\. \w\. \w\. {surname} and {given} \w+", got[4])
    assert re.fullmatch(r"call \d{10} now", got[5]) and "5552345678" not in got[5]
    assert not {"2001:db8::ff00:42:8329", "2001:0db8:0000:0000:0000:ff00:0042:8329"} & set(got[6].split())
    assert all(len(re.sub("[^:]", "", a)) == n for a, n in zip([w for w in got[6].split() if ":" in w], [5, 7], strict=True))
    assert got[7] == texts[7]
