"""Cross-entropy difference scoring with two n-gram models over one vocabulary.

Both models, target and background, are bigram models over all words of the corpus, counted exactly: the probability of
a word after another (or at a text's begin) is

    (count(before, word) + CONTEXT / VOCABULARY) / (count(before, any) + CONTEXT)

with the same pseudo-counts for both. The target is every document with a good label, the background every other one.
The counts of the larger are scaled down to the size of the smaller (``matched``: in characters), so pseudo-counts mean
the same in both, and a document's own words are taken out of its own model (it isn't asked what it itself has told).
A document's score is its mean loss a word under the target model less that under the background model: the lower, the
more it is like the target.

Counts and losses come from one shuffle. A text's loss is a sum over its n-grams of a function of that n-gram's counts
alone: + log(count + CONTEXT) for each word that another one follows, - log(count + CONTEXT / VOCABULARY) for each pair.
A task turns its documents into chunks, and a chunk into one packed record for each block of n-grams (by hash). All
occurrences of an n-gram meet in its block, are counted there and give each document its share of the loss, which
returns to the chunk, packed again. So models grow with the corpus, and no task holds one. N-grams that many documents
share (at least ``COMMON`` of a sample of ``SAMPLE`` documents: a bounded list, which says only where an n-gram is
counted, not how) don't go to blocks, where they'd be hot: their counts are summed by task and told to all.

N-grams are told apart by 63 bits of XXH64; of a thousand million different ones a pair shares them with a chance of 5 %.

Defined cases: a null or empty text has 0 words and null scores; labels that are null or without a document are left
out; without target (or without background) documents that model is flat, and scores still are finite; repeated rows
count and are scored each; an empty table gives an empty result; other input columns are not read.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.session import materialize, ship

#: Pseudo-counts behind a context, and the nominal number of words that they are dealt over.
CONTEXT, VOCABULARY = 50.0, 2.0**20
SAMPLE, COMMON = 2000, 0.01
#: Ids of target documents (some 90 bytes each in Spark) up to which they are broadcast; beyond, texts are shuffled to meet them.
BROADCAST_TARGET = 2_000_000
#: Characters of text to a block of n-grams; n-grams and documents to a chunk.
BLOCK_CHARS, CHUNK_GRAMS, CHUNK_DOCS = 6_000_000, 1_000_000, 60_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_KEPT: dict[bytes, int] = {}
_ODD = np.uint64(1)


def grams(text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
    """(words, distinct n-grams, their counts); an n-gram's lowest bit is 1 for a pair, 0 for a context."""
    import xxhash

    words = _WORD.findall((text or "").lower().encode())
    if not words:
        return 0, np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(_KEPT) > 400_000:
        _KEPT.clear()
    _KEPT.update((w, xxhash.xxh64_intdigest(w)) for w in set(words).difference(_KEPT))
    h = np.fromiter(map(_KEPT.__getitem__, words), np.uint64, len(words))
    before = np.concatenate([np.zeros(1, np.uint64), h[:-1]])
    pair = (before * np.uint64(0x9E3779B97F4A7C15)) ^ h
    pair = (pair ^ (pair >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    pair ^= pair >> np.uint64(32)
    found, count = np.unique(np.concatenate([before & ~_ODD, pair | _ODD]), return_counts=True)
    return len(words), found, count


def losses(gram: np.ndarray, own: np.ndarray, target: np.ndarray, n: np.ndarray, t: np.ndarray, scales: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(target, background) parts of the loss of ``own`` occurrences of each n-gram, seen n times in all and t times
    in the target, in a document that is target or not."""
    base = np.where(gram & _ODD == 1, CONTEXT / VOCABULARY, CONTEXT)
    sign = np.where(gram & _ODD == 1, -1.0, 1.0) * own
    in_target, in_rest = t - own * target, n - t - own * ~target
    return sign * np.log(in_target * scales[0] + base), sign * np.log(in_rest * scales[1] + base)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of like rank together, which compress where high ones are zero."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(data: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size).reshape(size, n).T).reshape(-1).view(kind)


def pack(gram: np.ndarray, doc: np.ndarray, own: np.ndarray) -> bytes:
    """Occurrences sorted by n-gram: each n-gram once, as a step from the last, with the number of its documents."""
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    steps = np.diff(gram[first], prepend=np.uint64(0))
    runs = np.diff(first, append=len(gram)).astype("<u4")
    wide = "<u4" if own.max() > 65535 else "<u2"
    parts = (_planes(steps.astype("<u8")), _planes(runs), _planes(doc.astype("<u2")), _planes(own.astype(wide)))
    return struct.pack("<IIB", len(first), len(gram), np.dtype(wide).itemsize) + b"".join(parts)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, n, wide = struct.unpack_from("<IIB", data)
    at = 9
    steps = _from_planes(data[at : at + 8 * k], "<u8", k)
    runs = _from_planes(data[at + 8 * k : at + 12 * k], "<u4", k)
    at += 12 * k
    return np.repeat(np.cumsum(steps, dtype=np.uint64), runs), _from_planes(data[at : at + 2 * n], "<u2", n), _from_planes(data[at + 2 * n :], f"<u{wide}", n)


ROW = "place long, chunk long, data binary, common binary, ids binary"


def _chunks(flagged: DataFrame, common: np.ndarray, blocks: int) -> DataFrame:
    """Rows by place: below ``blocks``, a chunk's packed n-grams of that block; -1 - chunk, the chunk itself."""
    shared = flagged.sparkSession.sparkContext.broadcast(common)

    def scan(batches):
        from pyspark import TaskContext

        common, chunk = shared.value, TaskContext.get().partitionId() << 20
        docs: list[tuple] = []
        found: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal chunk, held
            every, own = np.concatenate(found), np.concatenate(counts)
            doc = np.repeat(np.arange(len(docs)), [len(x) for x in found])
            target = np.array([d[2] for d in docs], bool)
            at = np.minimum(np.searchsorted(common, every), max(0, len(common) - 1))
            hot = common[at] == every if len(common) else np.zeros(len(every), bool)
            n, t = (np.bincount(at[m], own[m], len(common)).astype(np.int64) for m in (hot, hot & target[doc]))
            order = np.flatnonzero(hot)[np.argsort(at[hot], kind="stable")]
            kept = pack(at[order].astype(np.uint64), doc[order], own[order]) if len(order) else b""
            sizes = np.array([d[1] for d in docs], "<u4").tobytes()
            ids = pa.array([d[0] for d in docs], id_type)
            yield -1 - chunk, chunk, sizes + target.tobytes() + kept, n.tobytes() + t.tobytes(), pa.RecordBatch.from_arrays([ids], names=["id"])
            every, doc, own = every[~hot], doc[~hot], own[~hot]
            order = np.argsort(every, kind="stable")
            every, doc, own = every[order], doc[order], own[order]
            block = ((every >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
            cuts = np.concatenate([np.flatnonzero(np.diff(block, prepend=block[:1] + np.uint64(1))), [len(block)]]) if len(block) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield int(block[a]), chunk, pack(every[a:b], doc[a:b], own[a:b]), target.tobytes(), None
            docs.clear(), found.clear(), counts.clear()
            chunk, held = chunk + 1, 0

        def rows(made):
            for place, at, data, rest, ids in made:
                sink = None
                if ids is not None:
                    out = pa.BufferOutputStream()
                    with pa.ipc.new_stream(out, ids.schema) as w:
                        w.write_batch(ids)
                    sink = out.getvalue().to_pybytes()
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((place, at, data, rest, sink), kinds, strict=True)], names=["place", "chunk", "data", "common", "ids"])

        for b in batches:
            id_type = b.schema.field(0).type
            for key, text, target in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                n, gram, count = grams(text.as_py())
                docs.append((key, n, target))
                found.append(gram)
                counts.append(count)
                held += len(gram)
                if held >= CHUNK_GRAMS or len(docs) >= CHUNK_DOCS:
                    yield from rows(flush())
        if docs:
            yield from rows(flush())

    return flagged.mapInArrow(scan, ROW)


def _count(batches, scales: tuple[float, float]):
    """Rows of ``ROW`` sorted by place: of a block, each chunk's parts of losses; a chunk's own row as it is."""
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["place", "chunk", "data", "common", "ids"])

    def block(rows):
        parts = [unpack(r[2]) for r in rows]
        flags = [np.frombuffer(r[3], bool) for r in rows]
        gram, own = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts]).astype(np.int64)
        target = np.concatenate([f[p[1]] for f, p in zip(flags, parts, strict=True)])
        kinds, back = np.unique(gram, return_inverse=True)
        n, t = (np.bincount(back, own * m, len(kinds)).astype(np.int64)[back] for m in (True, target))
        lost = losses(gram, own, target, n, t, scales)
        at = 0
        for r, (_, doc, _), f in zip(rows, parts, flags, strict=True):
            span = slice(at, at + len(doc))
            at += len(doc)
            sums = [np.bincount(doc, x[span], len(f)) for x in lost]
            has = np.flatnonzero(np.bincount(doc, minlength=len(f)))
            yield r[0], r[1], _planes(has.astype("<u2")) + b"".join(_planes(s[has].astype("<f4")) for s in sums), None, None

    held: list[tuple] = []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if held and held[0][0] != row[0]:
                yield batch(block(held))
                held = []
            if row[0] < 0:
                yield batch([row])
            else:
                held.append(row)
    if held:
        yield batch(block(held))


def _finish(batches, common: tuple, scales: tuple[float, float], names: list[str]):
    """Rows of ``_count`` sorted by chunk and place: the documents of each chunk with their scores."""
    for rows in _by_chunk(batches):
        head = rows[0]  # the chunk's own, of negative place
        ids = pa.ipc.open_stream(head[4]).read_next_batch().column(0)
        n, size = len(ids), np.frombuffer(head[2], "<u4", len(ids)).astype(np.int64)
        target = np.frombuffer(head[2], bool, n, 4 * n)
        lost, (gram, count, t) = [np.zeros(n), np.zeros(n)], common
        if len(head[2]) > 5 * n:
            at, doc, own = unpack(head[2][5 * n :])
            at = at.astype(np.int64)
            lost = [np.bincount(doc, x, n) for x in losses(gram[at], own.astype(np.int64), target[doc], count[at], t[at], scales)]
        for r in rows[1:]:
            k = len(r[2]) // 10
            has = _from_planes(r[2], "<u2", k)
            for i, x in enumerate(lost):
                x[has] += _from_planes(r[2][2 * k + 4 * k * i :], "<f4", k)
        none = size == 0
        mean = [x / np.maximum(size, 1) for x in lost]
        cols = [ids, pa.array(size), *(pa.array(x, pa.float64(), mask=none) for x in (*mean, mean[0] - mean[1]))]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def _by_chunk(batches):
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if held and held[0][1] != row[1]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _shared(docs: DataFrame, text_col: str) -> np.ndarray:
    """The n-grams of at least ``COMMON`` of a sample's documents, sorted: at most the sample's n-grams / COMMON."""

    def scan(batches):
        for b in batches:
            found = [grams(t.as_py())[1] for t in b.column(0)]
            gram, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], names=["gram", "n"])

    counted = docs.select(text_col).limit(SAMPLE).mapInArrow(scan, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= max(2, SAMPLE * COMMON)).select("gram").collect()
    return np.sort(np.array([r["gram"] for r in rows], np.int64).view(np.uint64))


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score) for each row of ``docs``; score is their difference."""
    spark = docs.sparkSession
    ship(spark)
    good = materialize(labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("l_id")).distinct(), "target-ids")
    good = F.broadcast(good) if good.count() <= BROADCAST_TARGET else good.hint("merge")
    target = F.col("l_id").isNotNull().alias("target")
    sizes = docs.select(F.col(id_col).alias("d_id"), F.length(text_col).alias("size")).join(good, F.col("d_id") == F.col("l_id"), "left").groupBy(target).agg(F.sum("size").alias("size")).collect()
    size = {r["target"]: r["size"] or 0 for r in sizes}
    a, b = size.get(True, 0), size.get(False, 0)
    scales = (min(1.0, b / a), min(1.0, a / b)) if a and b else (1.0, 1.0)  # the larger is scaled down
    blocks = max(1, -(-(a + b) // BLOCK_CHARS))
    gram = _shared(docs, text_col)
    flagged = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("text")).join(good, F.col("d_id") == F.col("l_id"), "left").select("d_id", "text", target)
    chunks = _chunks(flagged, gram, blocks).repartition("place").sortWithinPartitions("place", "chunk")
    lost = materialize(chunks.mapInArrow(lambda batches: _count(batches, scales), ROW), "lm-losses")

    def add(batches):
        n = np.zeros(2 * len(gram), np.int64)
        for batch in batches:
            for x in batch.column(0):
                n += np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["at", "n"])

    told = np.zeros(2 * len(gram), np.int64)
    if len(gram):
        for r in lost.where("place < 0").select("common").mapInArrow(add, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            told[r["at"]] = r["n"]
    common = spark.sparkContext.broadcast((gram, told[: len(gram)], told[len(gram) :]))  # as long as the list of shared n-grams
    names = [id_col, "n_tokens", "target_loss", "background_loss", "score"]
    kind = docs.schema[id_col].dataType.simpleString()
    back = lost.repartition("chunk").sortWithinPartitions("chunk", "place")
    return back.mapInArrow(lambda batches: _finish(batches, common.value, scales, names), f"`{id_col}` {kind}, n_tokens long, target_loss double, background_loss double, score double")
