"""Exact top-k by inner product: branch and bound over columns.

Candidates lie in vertical layout (a row for each dimension). A query takes the dimensions in blocks, those first in
which it is largest itself, so that little mass remains early; what the dimensions still to come can add is at most the
product of the remaining norms (Cauchy-Schwarz). After each block the candidates whose upper bound is below the query's
k-th best are compacted away, and the next block is gathered for the survivors only. The k-th best starts from a first
pass over a bounded sample (``SEED`` rows), goes on over all of a task's batches, and only ever rises.

All plain scores are sums of integers below 2**53 in doubles, so they are exact, and bounds are widened by a rounding
margin, so no true answer is lost. Vectors whose norm is above 2**26 (finite components beyond some 10**5) are scored
in whole numbers of any size; a score beyond a long is that of the nearest long.

Queries go to the tasks by broadcast, in parts of ``QUERY_BYTES``; the parts' scans are one job. Each task returns its
own k best for each query, and these are merged.

Defined cases: a vector that is null, or holds a null or non-finite component, takes no part, nor does a row with a
null id; vectors of another length than the query's aren't its candidates; rows with the query's id are not its
candidates; a repeated query row is answered once, repeated candidates each count; ties go to the smaller id; fewer
candidates than k give them all; an empty table gives an empty result; other input columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import materialize, ship

#: Bytes of queries, as doubles, that are broadcast at once.
QUERY_BYTES = 64_000_000
DIM_BLOCK = 8
SEED = 1024
#: Candidates scored at once.
BATCH = 8192
PLAIN = 2.0**26
_LONG = 2**63 - 1


def quantized(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): whole numbers as doubles; beyond 2**53 a double is whole anyway."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    whole = lambda v: F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v)
    vector = F.transform(x, lambda v: whole(v.cast("double") * scale))
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(id_col).cast("long").alias("id"), vector.alias("v"))


class Candidates:
    """A batch of vectors of one length in vertical layout, those of large norm apart."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        with np.errstate(over="ignore"):
            norms = np.sqrt((vectors * vectors).sum(1))
        plain = norms <= PLAIN
        self.ids, self.columns = ids[plain], np.ascontiguousarray(vectors[plain].T)
        self.mass = norms[plain] ** 2
        self.large_ids, self.large = ids[~plain], vectors[~plain]
        self.all_ids, self.all = ids, vectors

    def best(self, q: np.ndarray, own: int, k: int, kth: float, passed: np.ndarray | None = None) -> tuple[np.ndarray, list[int]]:
        """(ids, scores) that reach ``kth`` and may be among the k best, not those of ``own``; ``passed`` counts the
        candidates that go into each block and, last, come out."""
        if not np.sqrt(float((q * q).sum())) <= PLAIN:
            use = np.flatnonzero(self.all_ids != own)
            return self._cut(self.all_ids[use], _whole(q, self.all[use]), k, kth)
        order = np.argsort(-np.abs(q), kind="stable")
        alive = np.flatnonzero(self.ids != own)
        score, mass, left = np.zeros(len(alive)), self.mass[alive], float((q * q).sum())
        for n, s in enumerate(range(0, len(q), DIM_BLOCK)):
            if passed is not None:
                passed[n] += len(alive)
            dims = order[s : s + DIM_BLOCK]
            part = self.columns[dims] if len(alive) == len(self.ids) else self.columns[dims][:, alive]
            score = score + q[dims] @ part
            mass = mass - np.einsum("ij,ij->j", part, part)
            left -= float((q[dims] ** 2).sum())
            rest = np.sqrt(max(left, 0.0) * np.maximum(mass, 0.0)) * (1 + 1e-9) + 1e-3 if s + DIM_BLOCK < len(q) else np.zeros(len(alive))
            if len(alive) > k:
                kth = max(kth, float(np.partition(score - rest, -k)[-k]))
            keep = score + rest >= kth
            if not keep.all():
                alive, score, mass = alive[keep], score[keep], mass[keep]
        if passed is not None:
            passed[-1] += len(alive)
        ids, scores = self.ids[alive], [int(x) for x in score]
        if len(self.large_ids):
            use = np.flatnonzero(self.large_ids != own)
            ids, scores = np.concatenate([ids, self.large_ids[use]]), scores + _whole(q, self.large[use])
        return self._cut(ids, scores, k, kth)

    @staticmethod
    def _cut(ids: np.ndarray, scores: list[int], k: int, kth: float) -> tuple[np.ndarray, list[int]]:
        best = sorted((i for i in range(len(ids)) if scores[i] >= kth), key=lambda i: (-scores[i], ids[i]))[:k]
        return ids[best], [scores[i] for i in best]


def _whole(q: np.ndarray, vectors: np.ndarray) -> list[int]:
    """Inner products of whole numbers of any size, cut to what a long holds."""
    mine = [int(x) for x in q]
    return [max(-_LONG - 1, min(_LONG, sum(a * int(b) for a, b in zip(mine, v, strict=True)))) for v in vectors]


def _grouped(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows of (id, v) by the vectors' length: (ids, vectors)."""
    by_length: dict[int, list] = {}
    for key, v in rows:
        by_length.setdefault(len(v), []).append((key, v))
    return {n: (np.array([i for i, _ in r], np.int64), np.array([v for _, v in r], np.float64).reshape(len(r), n)) for n, r in by_length.items()}


def first_pass(queries: dict, sample: dict, k: int) -> dict[int, np.ndarray]:
    """For each length, the k-th best score of each query among the sample's rows; -inf if they are fewer."""
    out = {}
    for n, (own, q) in queries.items():
        kth = np.full(len(own), -np.inf)
        if n in sample and len(sample[n][0]) > k:
            some = Candidates(sample[n][1], sample[n][0])
            for s in range(0, len(q), 1024):
                if len(some.ids) > k:
                    scores = np.where(own[s : s + 1024, None] == some.ids[None, :], -np.inf, q[s : s + 1024] @ some.columns)
                    kth[s : s + 1024] = np.partition(scores, -k, axis=1)[:, -k]
            kth[np.sqrt((q * q).sum(1)) > PLAIN] = -np.inf
        out[n] = kth
    return out


def top_k(df: DataFrame, is_query, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, id, score) for the rows that satisfy ``is_query``, against all other rows."""
    spark = df.sparkSession
    ship(spark)
    rows = quantized(df, id_col, vector_col, scale)
    asked = materialize(quantized(df.where(is_query), id_col, vector_col, scale).dropDuplicates(["id", "v"]), "queries")
    size = asked.agg(F.sum(F.size("v") * 8 + 64)).first()[0] or 0
    parts = max(1, -(-size // QUERY_BYTES))
    sample = _grouped([(r["id"], r["v"]) for r in rows.limit(SEED).collect()])
    numbered = asked.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(parts)))
    found = None
    for part in range(parts):  # each part is bounded in bytes
        queries = _grouped([(r["id"], r["v"]) for r in numbered.where(F.col("part") == part).orderBy("id", "v").collect()])
        one = _scan(rows, queries, first_pass(queries, sample, k), k, part)
        found = one if found is None else found.unionByName(one)
    w = Window.partitionBy("q", "query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _scan(rows: DataFrame, queries: dict, kth: dict, k: int, part: int) -> DataFrame:
    """(q, query_id, id, score): each task's k best of its candidates for each query; q numbers a query's vector."""
    shared = rows.sparkSession.sparkContext.broadcast((queries, kth))

    def scan(batches):
        queries, start = shared.value
        bound = {n: s.copy() for n, s in start.items()}
        best: dict[tuple[int, int], list] = {}

        def take(n: int, vectors: np.ndarray, ids: np.ndarray) -> None:
            some, (own, q) = Candidates(vectors, ids), queries[n]
            for j in range(len(own)):
                keys, scores = some.best(q[j], int(own[j]), k, bound[n][j])
                if len(keys):
                    mine = best.setdefault((n, j), [])
                    mine += zip((-x for x in scores), keys.tolist(), strict=True)
                    mine.sort()
                    del mine[k:]
                    if len(mine) == k:
                        bound[n][j] = max(bound[n][j], -mine[-1][0])

        waiting: dict[int, list] = {n: [] for n in queries}
        for b in batches:
            lengths = b.column(1).value_lengths().to_numpy()
            flat, ends, ids = b.column(1).flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths), b.column(0).to_numpy()
            for n in queries:
                pick = np.flatnonzero(lengths == n)
                if len(pick):
                    waiting[n].append((flat[(ends[pick] - n)[:, None] + np.arange(n)[None, :]], ids[pick]))
                if sum(len(i) for _, i in waiting[n]) >= BATCH:
                    take(n, *map(np.concatenate, zip(*waiting[n], strict=True)))
                    waiting[n] = []
        for n, w in waiting.items():
            if w:
                take(n, *map(np.concatenate, zip(*w, strict=True)))
        out = [(part << 40 | n << 24 | j, int(queries[n][0][j]), key, -neg) for (n, j), found in best.items() for neg, key in found]
        for s in range(0, len(out), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[s : s + 100_000], strict=True)], names=["q", "query_id", "id", "score"])

    return rows.mapInArrow(scan, "q long, query_id long, id long, score long")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
