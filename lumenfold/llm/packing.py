"""Packing documents into sequences of a fixed capacity by large-item matching and best fit.

Documents are encoded once; only those longer than the capacity are cut. Pieces of one length can stand for each
other, so the plan is made from the number of pieces of each length (at most ``capacity`` numbers, whatever the
data's size): pieces above a third of the capacity, of which no bin holds more than two, are matched greedily,
the longest with the longest that fits beside it; shorter ones, longest first, go where the gap that they leave is
least. The plan is a list of runs (length, first rank, first bin, pieces to a bin, offset), and each piece finds its
run by its rank among the pieces of its length. Ranks come from counts of (length, hash bucket), so that a length
that a third of all pieces share is dealt over ``BUCKETS`` tasks.

Defined cases: a null or empty text is one piece of one id (the end id); repeated rows are packed each for itself;
a null id packs like any other; an empty table gives an empty result; other input columns are not read.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.encoding import CACHE_WORDS, encoder, give_back
from lumenfold.session import materialize, ship

BUCKETS = 1024


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first bin, pieces to a bin, offset of the first in its bin)."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("piece lengths are from 1 to the capacity")
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_gaps: list[int] = []
    bins = 0

    def put(n: int, pieces: int, first_bin: int, to_bin: int, offset: int) -> None:
        runs.append((n, used[n], pieces, first_bin, to_bin, offset))
        used[n] += pieces
        left[n] -= pieces

    def open_bins(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                bisect.insort(open_gaps, gap)
            gaps.setdefault(gap, []).append((first, count))

    large = sorted(n for n in left if 3 * n > capacity)
    partners = list(large)
    for n in reversed(large):
        while left[n]:
            at = bisect.bisect_right(partners, capacity - n)
            while at and not left[partners[at - 1]]:
                del partners[at - 1]
                at -= 1
            other = partners[at - 1] if at else 0
            if other == n and left[n] > 1:
                count = left[n] // 2
                put(n, count * 2, bins, 2, 0)
                open_bins(capacity - 2 * n, bins, count)
            elif other and other != n:
                count = min(left[n], left[other])
                put(n, count, bins, 1, 0)
                put(other, count, bins, 1, n)
                open_bins(capacity - n - other, bins, count)
            elif other == n and (at := at - 1) and any(left[p] for p in partners[:at]):
                other = next(p for p in reversed(partners[:at]) if left[p])
                count = 1
                put(n, 1, bins, 1, 0)
                put(other, 1, bins, 1, n)
                open_bins(capacity - n - other, bins, 1)
            else:
                count = left[n]
                put(n, count, bins, 1, 0)
                open_bins(capacity - n, bins, count)
            bins += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(open_gaps, n)
            if at == len(open_gaps):
                to_bin = capacity // n
                count = -(-left[n] // to_bin)
                open_bins(capacity, bins, count)
                bins += count
                continue
            gap = open_gaps[at]
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], open_gaps[at]
            to_bin = min(gap // n, left[n])
            take = min(count, left[n] // to_bin)
            put(n, take * to_bin, first, to_bin, capacity - gap)
            open_bins(gap - to_bin * n, first, take)
            open_bins(gap, first + take, count - take)
    return runs


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, cache_words: int = CACHE_WORDS) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids cut at every ``capacity``."""
    ship(docs.sparkSession)

    def cut(batches):
        enc = encoder(tokenizer_path, end_id, cache_words)
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = enc.ids(text.as_py())
                wide = ids.astype("<u4")
                for i, s in enumerate(range(0, len(ids), capacity)):
                    part = wide[s : s + capacity]
                    for col, v in zip(rows, (key, i, s, len(part), zlib.crc32(part.tobytes())), strict=True):
                        col.append(v)
            kinds = (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=[id_col, "piece", "start", "length", "ids_crc32"])
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(cut, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, cache_words: int = CACHE_WORDS) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: the offsets of a sequence's pieces have no gaps from 0. Workers
    keep the ids of at most ``cache_words`` words, and stay: fewer cost CPU time and leave memory to other stages."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer_path, capacity, id_col=id_col, text_col=text_col, end_id=end_id, cache_words=cache_words), "pieces")
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    cells = materialize(keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = np.array(plan_bins(counts, capacity), dtype=np.int64).reshape(-1, 6)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shared = spark.sparkContext.broadcast(runs)  # made from `capacity` counts, so its size doesn't follow the data's
    w = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select("length", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(id_col, "piece", "ids_crc32"))
    ranked = keyed.withColumn("place", place).join(before, ["length", "bucket"])
    ranked = ranked.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place") - 1).cast("long").alias("rank"))

    def assign(batches):
        r = shared.value
        span = int(r[:, 1].max() + r[:, 2].max() + 1) if len(r) else 1
        key = r[:, 0] * span + r[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            run = r[np.searchsorted(key, length * span + rank, side="right") - 1]
            bin_, at = np.divmod(rank - run[:, 1], run[:, 4])
            cols = [b.column(i) for i in range(5)] + [pa.array(run[:, 3] + bin_), pa.array(run[:, 5] + at * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(assign, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
