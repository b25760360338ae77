"""Exact Jaccard self-join of documents on their sets of word shingles: a size-aware heavy-light join.

Two documents link if ``100 * |A and B| >= percent * |A or B|``, that is, if they share at least ``least(n, m)`` shingles.

*Light* sets, of up to a boundary of shingles, are joined by their subsets: a pair that shares t = least(n, m) shingles
shares a subset of t. A set gives all its subsets of every t that a partner can ask for (those that drop up to a fifth of
it, at 80 %), keyed by two sums of mixed hashes; all sets of a key that are small enough for t link to its smallest, so a
key of g sets gives g - 1 links, and none has to be looked at again.

*Heavy* sets are found by scanning inverted lists. All sets keep their shingles in one order (frequent ones last, else by
hash); a pair that shares ``least`` of them shares one among the first n - least + 1 of each, so a list holds the sets that
have a shingle among those. Of a list, each set is first held against its leader; a list whose sets are then not all of
one component is scanned pair by pair across components, in blocks of ``BLOCK`` sets, so that a long list is many tasks.
A scan drops no pair that may link: sizes, places in the prefix (behind the first shingle that a pair shares, both must have
what they must share), and parity bitmaps decide (a bit is the parity of the shingles that fall on it, so bitmaps differ in
no more bits than the sets in shingles). It gives a spanning forest of
the pairs that pass, not all of them; exact sets decide each, components are made anew, and scans go on until they give
nothing new; the last gives every pair that still passes. Light sets of nearly the boundary's size are in the lists too,
for heavy partners.

The boundary minimises, over a bounded sample of texts, the subsets of light sets plus the entries and scanned lists of
heavy ones. Which shingles are frequent is counted on Spark over every ``COUNTED``-th text, a share of the table, so that
lists don't grow with it; of more than ``MOST`` the rarer ones aren't told. Both affect cost alone, never a result.

Sets are told apart by 88 bits, shingles by 64 (XXH64 of the UTF-8 text), lists by 40. Equal sets are one node.

Defined cases: a null or empty text, or one without words, has the empty set and links with nothing; fewer words than a
shingle give one shingle; repeated rows share everything; ids may be null (a null id is never a component's smallest
unless all are null; without words it is its own component); an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import simhash
from lumenfold.llm.encoding import give_back
from lumenfold.session import materialize, ship

#: Distinct texts of the sample, and the smallest hashes kept of each.
SAMPLE, KEPT = 2048, 1024
#: Of so many texts the shingles of one are counted; how often one is frequent, and how many are told (16 bytes each).
COUNTED, OFTEN, MOST = 4, 4, 1 << 20
#: The largest boundary that is considered.
LIGHT = 20
#: Sets of a list that one task holds against each other.
BLOCK = 1024
#: Lists up to so many sets are looked at by sizes and places before bitmaps are fetched.
SMALL = 32
#: Rounds of a list's scan that give a forest; one that gives all that is left follows.
ROUNDS = 2
#: Nodes that a worker remembers so as to send a set's lists once.
SEEN = 200_000
#: Texts whose sets are needed are picked by broadcast up to so many marks (8 bytes each), and by shuffle beyond.
BROADCAST_MARKS = 2_000_000
_LOW = np.uint64((1 << 24) - 1)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def least(n, m, percent: int):
    """Shingles that sets of n and m must share."""
    return -(-percent * (n + m) // (100 + percent))


def hashes(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The XXH64 of the text's shingles, repeats included, in order; A-Z count as a-z."""
    import xxhash

    words = simhash._WORD.findall((text or "").encode().translate(simhash._LOWER))
    if not words:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(whole, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()][: len(words) - width + 1]
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(whole[a:b], seed) for a, b in zip(starts, stops, strict=True)])
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes, sorted."""
    return np.unique(hashes(text, width, seed))


def fingerprint(found: np.ndarray) -> int:
    """As ``simhash.fingerprint``, from the hashes, as a signed long."""
    total = np.zeros(64, np.int64)
    for s in range(0, len(found), 65536):
        total += np.unpackbits(found[s : s + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > max(1, len(found))).tobytes(), "big", signed=True)


def node_of(found: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh128_digest(found.tobytes())[:11]


def parity(found: np.ndarray) -> bytes:
    """A bitmap of at least two bits a shingle, a power of two; that of half the length is the XOR of its halves."""
    size = 256
    while size < 2 * len(found):
        size *= 2
    return np.packbits(np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def folded(bits: bytes, size: int) -> bytes:
    while len(bits) > size:
        half = len(bits) // 2
        bits = (int.from_bytes(bits[:half], "big") ^ int.from_bytes(bits[half:], "big")).to_bytes(half, "big")
    return bits


def may_link(n: int, m: int, a: bytes, b: bytes, percent: int) -> bool:
    size = min(len(a), len(b))
    differ = (int.from_bytes(folded(a, size), "big") ^ int.from_bytes(folded(b, size), "big")).bit_count()
    return differ <= n + m - 2 * least(n, m, percent)


def in_order(found: np.ndarray, frequent: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sorted hashes in the order of all sets: frequent ones last, by how frequent they are."""
    at = np.searchsorted(frequent, found)
    at[at == len(frequent)] = 0
    often = frequent[at] == found if len(frequent) else np.zeros(len(found), bool)
    last = found[often]
    return np.concatenate([found[~often], last[np.lexsort((last, count[at[often]]))]]) if often.any() else found


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


@cache
def _dropped(n: int, k: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), k)), np.int64).reshape(comb(n, k), k)


def n_subsets(n: int, percent: int) -> int:
    return sum(comb(n, k) for k in range(n - -(-percent * n // 100) + 1))


def subset_keys(found: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two longs and t for each subset: sums of mixed hashes, which don't depend on an order."""
    n = len(found)
    keys: list[list[np.ndarray]] = [[], []]
    ts = []
    for k in range(n - -(-percent * n // 100) + 1):
        gone = _dropped(n, k)
        for half, mix in enumerate(_MIX):
            x = found * mix
            x = (x ^ (x >> np.uint64(31))) * _MIX[1 - half]
            x ^= x >> np.uint64(29)
            keys[half].append(x.sum(dtype=np.uint64, keepdims=True) - x[gone].sum(1, dtype=np.uint64) + np.uint64((n - k) * int(mix) & (1 << 64) - 1))
        ts.append(np.full(len(gone), n - k, np.int32))
    return np.concatenate(keys[0]).view(np.int64), np.concatenate(keys[1]).view(np.int64), np.concatenate(ts)


def _frequent(docs: DataFrame, text_col: str, width: int, share: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles, sorted, and how often each is in ``share`` of 2 ** 30 texts. Of a set its first hashes are counted,
    twice as many as a prefix has: the others are late in the order anyway."""

    def scan(batches):
        seen: set[int] = set()
        for b in batches:
            new = [i for i, m in enumerate(b.column(1).to_pylist()) if not (m in seen or seen.add(m))]
            if len(seen) > SEEN:
                seen.clear()
            sets = [shingles(b.column(0)[i].as_py(), width) for i in new]
            yield pa.RecordBatch.from_arrays([pa.array([s[: 16 + 2 * len(s) // 5].view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["items"])
        give_back()

    mark = F.xxhash64(text_col)
    texts = docs.select(F.col(text_col).alias("text"), mark.alias("mark")).where(F.pmod("mark", F.lit(1 << 30)) < share)
    counted = texts.mapInArrow(scan, "items array<long>").select(F.explode("items").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    counted = materialize(counted, "frequent")
    bound, told = OFTEN, 0
    for r in counted.groupBy(F.least("n", F.lit(1 << 12)).alias("n")).count().orderBy(F.desc("n")).collect():  # at most 4096 rows
        told += r["count"]
        if told > MOST:
            bound = r["n"] + 1
            break
    got = counted.where(F.col("n") >= bound).toArrow()
    x, n = got.column("x").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(x)
    return x[order], n[order]


def plan(docs: DataFrame, text_col: str, width: int, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(frequent shingles, sorted; how often each was counted; the boundary)."""
    ship(docs.sparkSession)
    total = docs.count()
    mark = F.xxhash64(text_col)
    share = min(1 << 30, (SAMPLE << 30) // max(1, total))
    texts = docs.where(F.pmod(mark, F.lit(1 << 30)) < share).groupBy(mark.alias("mark")).agg(F.first(text_col).alias("text")).select("text")

    def scan(batches):
        for b in batches:
            sets = [shingles(t.as_py(), width) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in sets], pa.int64()), pa.array([s[:KEPT].tobytes() for s in sets], pa.binary())], names=["n", "items"])

    got = texts.mapInArrow(scan, "n long, items binary").limit(2 * SAMPLE).collect()  # at most 2 * SAMPLE * KEPT hashes
    sets = [(r["n"], np.frombuffer(bytes(r["items"]), np.uint64)) for r in got if r["n"]]
    if not sets:
        return np.empty(0, np.uint64), np.empty(0, np.int64), 0
    values, count = np.unique(np.concatenate([s for _, s in sets]), return_counts=True)
    frequent, times = _frequent(docs, text_col, width, max(share, (1 << 30) // COUNTED))
    more = total / len(got)
    light, heavy = np.zeros(LIGHT + 1), np.zeros(LIGHT + 1)
    for n, s in sets:
        if n > LIGHT:
            continue  # heavy whatever the boundary
        scanned = count[np.searchsorted(values, in_order(s, frequent, times)[: prefix_size(n, percent)])] - 1
        light[n] += n_subsets(n, percent)
        heavy[n] += prefix_size(n, percent) + scanned.sum() * more
    cost = np.cumsum(light) + heavy.sum() - np.cumsum(heavy)
    return frequent, times, int(cost.argmin())


SKETCH = "id {0}, mark long, node binary, n int, bits binary, low long, lists array<long>, k1 array<long>, k2 array<long>, ts array<int>, fp long"


def sketches(docs: DataFrame, how: tuple[np.ndarray, np.ndarray, int], id_col: str, text_col: str, width: int, percent: int, prints: bool = False) -> DataFrame:
    """One row a document, with the SimHash fingerprint of its shingles if ``prints``. ``lists`` are the first shingles' upper 40 bits above 24 of the node's, whose other 64 are ``low``;
    a worker sends the lists and subsets of a set once while it remembers it."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(how)  # bounded by the sample

    def scan(batches):
        frequent, times, boundary = shared.value
        seen: set[bytes] = set()
        for b in batches:
            rows = []
            for t in b.column(1):
                all_ = hashes(t.as_py(), width)
                own = np.unique(all_)
                n, node = len(own), node_of(own)
                lists, subsets = np.empty(0, np.int64), (np.empty(0, np.int64),) * 2 + (np.empty(0, np.int32),)
                if n and node not in seen:
                    seen.add(node)
                    if (100 * n) > percent * boundary:
                        first = in_order(own, frequent, times)[: prefix_size(n, percent)]
                        lists = ((first & ~_LOW) | np.uint64(int.from_bytes(node[:3], "big"))).view(np.int64)
                    if n <= boundary:
                        subsets = subset_keys(own, percent)
                rows.append((node, n, parity(own), int.from_bytes(node[3:], "big", signed=True), lists, *subsets, fingerprint(all_) if prints else 0))
            if len(seen) > SEEN:
                seen.clear()
            cols = list(zip(*rows, strict=True)) if rows else [()] * 9
            longs = pa.list_(pa.int64())
            kinds = [pa.binary(), pa.int32(), pa.binary(), pa.int64(), longs, longs, longs, pa.list_(pa.int32()), pa.int64()]
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *made], names=["id", "mark", "node", "n", "bits", "low", "lists", "k1", "k2", "ts", "fp"])
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark")).mapInArrow(scan, SKETCH.format(kind))


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of its run's first row, size of its run) of each row, and the runs' starts."""
    start = np.ones(len(key), bool)
    start[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(start)
    run = np.cumsum(start) - 1
    return at[run], np.bincount(run)[run], at


def members(sketched: DataFrame, boundary: int, percent: int) -> DataFrame:
    """(bucket, node, n, place, leader, leader_n, scan) of the lists of several sets, read as a sorted stream. Of small lists,
    sets without a partner that they could link with aren't given, and ``scan`` is false where the leader is the only one."""

    def scan(batches):
        kept = None  # the first row of the run that goes on, and whether it was given
        for b in batches:
            x, y, n, s = (b.column(i).to_numpy() for i in range(4))
            given = kept is not None and kept[1]
            if kept is not None:
                x, y, n, s = (np.concatenate([np.array([f], v.dtype), v]) for f, v in zip(kept[0], (x, y, n, s), strict=True))
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            x, y, n, s = (v[new] for v in (x, y, n, s))
            key = x.view(np.uint64) >> np.uint64(24)
            lead, size, at = _runs(key)
            last = at[-1]
            # the runs that are whole in this batch and small can be looked at by sizes and places alone
            out, scan_it = size > 1, size > 1
            for r in range(2, SMALL + 1):
                runs = at[(size[at] == r) & (at != last) & ~((at == 0) & given)]
                if not len(runs):
                    continue
                rows = runs[:, None] + np.arange(r)
                fits = _compatible(n[rows][:, :, None], s[rows][:, :, None], n[rows][:, None, :], s[rows][:, None, :], boundary, percent)
                fits[:, np.arange(r), np.arange(r)] = False
                out[rows] = fits.any(2)
                fits[:, 0, :] = fits[:, :, 0] = False  # the leader's pairs are decided anyway
                scan_it[rows] = fits.any(2)
                scan_it[runs] = scan_it[rows].any(1)
            if given:
                out[0] = False
            kept = ((x[last], y[last], n[last], s[last]), bool(size[last] > 1) or (given and last == 0))
            pick = np.flatnonzero(out)
            if not len(pick):
                continue
            lead = lead[pick]
            named = lambda i: [int(a).to_bytes(3, "big") + int(c).to_bytes(8, "big") for a, c in zip((x[i].view(np.uint64) & _LOW).tolist(), y[i].view(np.uint64).tolist(), strict=True)]  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[pick].view(np.int64)), pa.array(named(pick), pa.binary()), pa.array(n[pick]), pa.array(s[pick]), pa.array(named(lead), pa.binary()), pa.array(n[lead]), pa.array(scan_it[pick])],
                names=["bucket", "node", "n", "place", "leader", "leader_n", "scan"],
            )

    # of two shingles of a set that fall into one list, the first place counts
    entries = sketched.select("n", F.col("low").alias("y"), F.posexplode("lists").alias("place", "x"))
    entries = entries.repartition(F.shiftrightunsigned("x", 24)).sortWithinPartitions("x", "y", "place")
    return entries.select("x", "y", "n", "place").mapInArrow(scan, "bucket long, node binary, n int, place int, leader binary, leader_n int, scan boolean")


def _compatible(n, s, m, r, boundary: int, percent: int):
    """Whether sets of n and m can link by the list that they share, if it is their first one: one is heavy, sizes allow it, and
    both have as many shingles from their place there, s and r, as they must share."""
    small, large = np.minimum(n, m).astype(np.int64), np.maximum(n, m).astype(np.int64)
    shared = least(small, large, percent)
    return (large > boundary) & (100 * small >= percent * large) & (n - s >= shared) & (m - r >= shared)


def light_links(sketched: DataFrame, percent: int) -> DataFrame:
    """(a, b) of light sets that link: each set of a subset's key to its smallest."""

    def scan(batches):
        kept = None
        for b in batches:
            k1, k2, t, n = (b.column(i).to_numpy() for i in range(4))
            node = b.column(4).to_pylist()
            if kept is not None:
                k1, k2, t, n = (np.concatenate([np.array([f], v.dtype), v]) for f, v in zip(kept, (k1, k2, t, n), strict=False))
                node = [kept[4], *node]
            start = np.ones(len(k1), bool)
            start[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (t[1:] != t[:-1])
            at = np.flatnonzero(start)
            lead = at[np.cumsum(start) - 1]
            last = at[-1]
            kept = (k1[last], k2[last], t[last], n[last], node[last])
            fits = percent * (n.astype(np.int64) + n[lead]) <= (100 + percent) * t.astype(np.int64)
            pick = [i for i in np.flatnonzero(fits & (np.arange(len(n)) != lead)).tolist() if node[i] != node[lead[i]]]
            if pick:
                yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in pick], pa.binary()), pa.array([node[lead[i]] for i in pick], pa.binary())], names=["a", "b"])

    keys = sketched.where(F.size("k1") > 0).select("node", "n", F.explode(F.arrays_zip("k1", "k2", "ts")).alias("k"))
    keys = keys.select("k.k1", "k.k2", F.col("k.ts").alias("t"), "n", "node").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "t", "n", "node")
    return keys.mapInArrow(scan, "a binary, b binary").distinct()


def _sets(docs: DataFrame, nodes: DataFrame, text_col: str, width: int) -> DataFrame:
    """(s_node, items) of the nodes (w_node, mark): items are the sorted hashes of the set."""

    def scan(batches):
        seen: set[int] = set()
        for b in batches:
            new = [i for i, m in enumerate(b.column(1).to_pylist()) if not (m in seen or seen.add(m))]
            if len(seen) > SEEN:
                seen.clear()
            sets = [shingles(b.column(0)[i].as_py(), width) for i in new]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["s_node", "items"])
        give_back()

    marks = nodes.select(F.col("mark").alias("w_mark")).distinct()
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_MARKS else marks.hint("merge")
    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark")).join(marks, F.col("mark") == F.col("w_mark"), "left_semi")
    return texts.mapInArrow(scan, "s_node binary, items binary").dropDuplicates(["s_node"])


def decide(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, links) for each pair, by the exact sets."""
    side = lambda name: sets.select(F.col("s_node").alias(f"{name}_node"), F.col("items").alias(f"{name}_items")).hint("merge")
    both = pairs.join(side("a"), F.col("a") == F.col("a_node")).join(side("b"), F.col("b") == F.col("b_node")).select("a", "b", "a_items", "b_items")

    def scan(batches):
        for batch in batches:
            links = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                every = np.sort(np.concatenate([p, q]), kind="stable")
                shared = int((every[1:] == every[:-1]).sum())
                links.append(100 * shared >= percent * (len(every) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(links, pa.bool_())], names=["a", "b", "links"])
        give_back()

    return both.mapInArrow(scan, "a binary, b binary, links boolean")


def _passing(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that parity bitmaps allow."""
    side = lambda name: nodes.select(F.col("node").alias(f"{name}_node"), F.col("n").alias(f"{name}_n"), F.col("bits").alias(f"{name}_bits")).hint("merge")
    both = pairs.join(side("a"), F.col("a") == F.col("a_node")).join(side("b"), F.col("b") == F.col("b_node")).select("a", "b", "a_n", "b_n", "a_bits", "b_bits")

    def scan(batches):
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(2, 6)]
            fine = [may_link(n, m, p, q, percent) for n, m, p, q in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return both.mapInArrow(scan, "a binary, b binary")


class _Bitmaps:
    """Parity bitmaps of several lengths, as rows of longs; a pair is compared at the shorter's length."""

    def __init__(self, bits: list[bytes]):
        self.sizes = np.array([len(b) for b in bits])
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in np.unique(self.sizes).tolist():  # lengths of sets that can link differ by a factor of two at most
            rows = np.flatnonzero((self.sizes == size) | (self.sizes == 2 * size))
            place = np.full(len(bits), -1)
            place[rows] = np.arange(len(rows))
            self.at[size] = place, np.frombuffer(b"".join(folded(bits[i], size) for i in rows.tolist()), np.uint64).reshape(len(rows), -1)

    def differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.int64)
        size = np.minimum(self.sizes[a], self.sizes[b])
        for s in np.unique(size).tolist():
            which = np.flatnonzero(size == s)
            step = max(1, (1 << 22) // (s // 8))
            place, t = self.at[s]
            for i in range(0, len(which), step):
                w = which[i : i + step]
                out[w] = np.bitwise_count(t[place[a[w]]] ^ t[place[b[w]]]).sum(1, dtype=np.int64)
        return out


def _root(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def scan_list(n, place, comp, block, bits, ends, boundary: int, percent: int, every: bool):
    """Pairs (positions) across components that sizes, places and bitmaps allow: all, or enough to connect what they connect.
    ``ends``: the two blocks that are held against each other, or one block twice."""
    maps = _Bitmaps(bits)
    k = len(n)
    root = np.arange(int(comp.max()) + 1 if k else 0)
    left = np.flatnonzero(block == ends[0])
    right = left if ends[0] == ends[1] else np.flatnonzero(block == ends[1])
    out_a: list[np.ndarray] = []
    out_b: list[np.ndarray] = []

    def held(some: np.ndarray):
        now = comp if every else np.array([_root(root, int(c)) for c in comp])
        fine = _compatible(n[some][:, None], place[some][:, None], n[right][None, :], place[right][None, :], boundary, percent) & (now[some][:, None] != now[right][None, :])
        i, j = np.nonzero(fine)
        a, b = some[i], right[j]
        if ends[0] == ends[1] and every:
            a, b = a[a < b], b[a < b]
        passes = maps.differing(a, b) <= n[a].astype(np.int64) + n[b] - 2 * least(n[a].astype(np.int64), n[b], percent)
        a, b = a[passes], b[passes]
        if every:
            out_a.append(a)
            out_b.append(b)
            return
        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            x, y = _root(root, int(comp[p])), _root(root, int(comp[q]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out_a.append(np.array([p]))
                out_b.append(np.array([q]))

    step = max(1, (1 << 20) // max(1, len(right)))
    # a forest begins with few sets against all, so that what they connect need not be compared any more
    cuts = [*range(0, min(len(left), 8)), *range(8, len(left), step), len(left)] if not every else [*range(0, len(left), step), len(left)]
    for s, e in itertools.pairwise(cuts):
        held(left[s:e])
    empty = np.empty(0, np.int64)
    return np.concatenate(out_a or [empty]), np.concatenate(out_b or [empty])


def _scanned(lists: DataFrame, bits: DataFrame, boundary: int, percent: int, every: bool) -> DataFrame:
    """(a, b) from lists (bucket, node, n, place, comp); long ones are held block against block. Bitmaps (b_node, bits) come last,
    so that they are sent once."""
    size = lists.groupBy(F.col("bucket").alias("z_bucket")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    rows = lists.join(size, F.col("bucket") == F.col("z_bucket"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "node", "n", "place", "comp", "block")

    def pairs_of(t: pa.Table) -> pa.RecordBatch:
        """The pairs of whole runs; small ones all at once, others one by one."""
        key = [t.column(c).to_numpy() for c in ("bucket", "one", "two")]
        node, bits = t.column("node").to_pylist(), t.column("bits").to_pylist()
        n, place, block = (t.column(c).to_numpy() for c in ("n", "place", "block"))
        comp = np.unique(np.array(t.column("comp").to_pylist(), object), return_inverse=True)[1].ravel()
        start = np.ones(len(n), bool)
        start[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        at = np.flatnonzero(start)
        size = np.diff([*at, len(n)])
        found_a, found_b = [], []
        for r in range(2, SMALL + 1):
            rows = at[size == r][:, None] + np.arange(r)
            for s in range(0, len(rows), 1 + (1 << 20) // (r * r)):
                some = rows[s : s + 1 + (1 << 20) // (r * r)]
                fits = _compatible(n[some][:, :, None], place[some][:, :, None], n[some][:, None, :], place[some][:, None, :], boundary, percent)
                fits &= comp[some][:, :, None] != comp[some][:, None, :]
                run, i, j = np.nonzero(np.triu(fits, 1))
                found_a.append(some[run, i])
                found_b.append(some[run, j])
        a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (found_a, found_b))
        if len(a):
            used = np.unique(np.concatenate([a, b]))
            maps = _Bitmaps([bits[i] for i in used.tolist()])
            passes = maps.differing(np.searchsorted(used, a), np.searchsorted(used, b)) <= n[a].astype(np.int64) + n[b] - 2 * least(n[a].astype(np.int64), n[b], percent)
            a, b = a[passes], b[passes]
        out = set()
        root: dict[tuple[int, int], tuple[int, int]] = {}  # of a run's components

        def find(x: tuple[int, int]) -> tuple[int, int]:
            while root.get(x, x) != x:
                x = root[x]
            return x

        run = np.searchsorted(at, a, "right")
        for g, i, j in zip(run.tolist(), a.tolist(), b.tolist(), strict=True):
            x, y = find((g, int(comp[i]))), find((g, int(comp[j])))
            if every or x != y:
                root[x] = y
                out.add((node[i], node[j]) if node[i] < node[j] else (node[j], node[i]))
        for g in np.flatnonzero(size > SMALL).tolist():
            s, e = int(at[g]), int(at[g] + size[g])
            own = np.unique(comp[s:e], return_inverse=True)[1].ravel()
            ends = int(key[1][s]), int(key[2][s])
            for i, j in zip(*(x.tolist() for x in scan_list(n[s:e], place[s:e], own, block[s:e], bits[s:e], ends, boundary, percent, every)), strict=True):
                x, y = node[s + i], node[s + j]
                out.add((x, y) if x < y else (y, x))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    def scan(batches):
        held: list[pa.RecordBatch] = []  # rows of a run that may go on
        for batch in batches:
            t = pa.Table.from_batches([*held, batch])
            key = [t.column(c).to_numpy() for c in ("bucket", "one", "two")]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0))
            if not len(new):
                held.append(batch)
                continue
            cut = int(new[-1]) + 1
            held = t.slice(cut).to_batches()
            yield pairs_of(t.slice(0, cut))
        if held:
            yield pairs_of(pa.Table.from_batches(held))
        give_back()

    rows = rows.join(bits, F.col("node") == F.col("b_node")).drop("b_node")
    rows = rows.repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two", "node")
    return rows.mapInArrow(scan, "a binary, b binary").distinct()


def _components(links: DataFrame) -> DataFrame:
    return materialize(simhash.components(links).select(F.col("node").alias("k_node"), "root"), "components").hint("merge")


def linked(docs: DataFrame, nodes: DataFrame, sketched: DataFrame, boundary: int, percent: int, text_col: str, width: int, more: DataFrame | None = None) -> DataFrame:
    """(k_node, root) of the nodes that link with others. ``more``: pairs (a, b) of nodes to decide besides."""
    light = materialize(light_links(sketched, percent), "light-links") if boundary else None
    found = materialize(members(sketched, boundary, percent), "lists")
    small, large = F.least("n", "leader_n").cast("long"), F.greatest("n", "leader_n").cast("long")
    near = (F.col("node") != F.col("leader")) & (large > boundary) & (100 * small >= percent * large)
    star = found.where(near).select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    if more is not None:
        star = star.unionByName(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    star = materialize(_passing(materialize(star.distinct(), "to-leaders"), nodes, percent), "passing")
    # what a scan of the lists gives before anything is decided, with pairs to leaders taken as links: the texts needed
    guess = _components(star if light is None else star.unionByName(light))
    lists = found.where("scan").select("bucket", "node", "n", "place")
    lists = lists.join(guess, F.col("node") == F.col("k_node"), "left").withColumn("comp", F.coalesce("root", "node")).drop("k_node", "root")
    bits = nodes.select(F.col("node").alias("b_node"), "bits").hint("merge")
    mixed = lambda rows: rows.join(rows.groupBy(F.col("bucket").alias("v_bucket")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("v_bucket").hint("merge"), F.col("bucket") == F.col("v_bucket"), "left_semi")
    lists = materialize(mixed(materialize(lists, "lists")), "mixed-lists")
    pairs = materialize(_scanned(lists, bits, boundary, percent, False), "scanned").unionByName(star).distinct()
    sets = materialize(_sets(docs, _marks(pairs, nodes), text_col, width), "items")
    tried = materialize(decide(pairs, sets, percent), "decided")
    known = tried.where("links").select("a", "b")
    links = known if light is None else known.unionByName(light)
    base = _components(links)
    # a set that no pair has passed with yet was held against all of its lists, and won't be again
    ends = pairs.select(F.explode(F.array("a", "b")).alias("e_node")).distinct().hint("merge")
    lists = materialize(lists.select("bucket", "node", "n", "place").join(ends, F.col("node") == F.col("e_node"), "left_semi"), "lists")
    turn, every, joined = 0, False, True
    while True:
        now = lists.join(base, F.col("node") == F.col("k_node"), "left").withColumn("comp", F.coalesce("root", "node")).drop("k_node", "root")
        again = materialize(_scanned(mixed(materialize(now, "lists")), bits, boundary, percent, every), "scanned")
        known = tried.select(F.col("a").alias("t_a"), F.col("b").alias("t_b")).hint("merge")
        new = materialize(again.join(known, (F.col("a") == F.col("t_a")) & (F.col("b") == F.col("t_b")), "left_anti"), "untried")
        if new.isEmpty() and (every or again.isEmpty()):
            return base
        if not new.isEmpty():
            missing = _marks(new, nodes, sets)
            if not missing.isEmpty():
                sets = materialize(sets.unionByName(_sets(docs, missing, text_col, width)).dropDuplicates(["s_node"]), "items")
            decided = materialize(decide(new, sets, percent), "decided")
            tried = tried.unionByName(decided)
            more = decided.where("links").select("a", "b")
            joined = not more.isEmpty()
            if joined:
                links = links.unionByName(more)
                base = _components(links)
            if every:
                return base
        turn += 1
        every = turn >= ROUNDS or new.isEmpty() or not joined


def _marks(pairs: DataFrame, nodes: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """(w_node, mark) of the pairs' nodes, of those that ``sets`` doesn't have."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("w_node")).distinct()
    if sets is not None:
        ends = ends.join(sets.select("s_node"), F.col("w_node") == F.col("s_node"), "left_anti")
    return materialize(nodes.select("node", "mark").join(ends.hint("merge"), F.col("node") == F.col("w_node")).select("w_node", "mark"), "marks")


def join(docs: DataFrame, *, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row of ``docs``; component_id is the smallest id reachable by links."""
    ship(docs.sparkSession)
    how = plan(docs, text_col, width, percent)
    every = materialize(sketches(docs, how, id_col, text_col, width, percent), "sketches")
    nodes = every.groupBy("node").agg(F.min("id").alias("least"), F.min("mark").alias("mark"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    nodes = materialize(nodes, "sets")
    base = linked(docs, nodes, every, how[2], percent, text_col, width)
    out = named(every, nodes, base)
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def named(every: DataFrame, nodes: DataFrame, base: DataFrame) -> DataFrame:
    """(id, n, component_id) of the sketched documents, from the links' components."""
    rooted = nodes.select("node", "least").join(base, F.col("node") == F.col("k_node"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    known = materialize(rooted.join(smallest.hint("merge"), F.col("root") == F.col("r")).select(F.col("node").alias("m_node"), "component_id"), "named").hint("merge")
    return every.select("id", "node", "n").join(known, F.col("node") == F.col("m_node")).select("id", "n", "component_id")
