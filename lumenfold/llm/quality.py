"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model on the shape of a text (what its words look like, how they repeat, how long they are; the whole
text is read) gives each document's own evidence. It is fitted on at most ``max_labelled`` labelled documents, those
with the smallest hash of their id, so the bound holds at every size of the corpus. Grouped sums over all documents
then give host and path means. The spread of host means around the global one, beyond what their sizes explain,
sets the strength of the global prior (method of moments); a host's posterior is its own sum shrunk to the global
mean by that strength, and a path's is shrunk to its host's. A document's posterior odds are its own odds, less the
global prior's, times its path's: sparse sites change little, large ones as much as they have shown.

Defined cases: a null or empty text has no good words and is rejected; a null source is a host of its own, and so is
a null path; labels that are null, repeated or without a document are left out; without labels of both kinds every
document with a word is kept; repeated rows are scored alike; an empty table gives an empty result. Input columns
named like an output column are replaced by it.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.session import materialize, ship

BROADCAST_SITES = 50_000
HASHED = 4096
DENSE = 14
WIDTH = HASHED + DENSE
_CLASS = bytes(
    (97 if chr(c).islower() or c > 127 else 65 if chr(c).isupper() else 48 if chr(c).isdigit() else 32 if c in (9, 10, 11, 12, 13, 32) else c) for c in range(256)
)
_SLOTS: dict[bytes, int] = {}


def _slot(shape: bytes) -> int:
    """The place of a word's shape: letters a or A, digits 0, runs shortened to two."""
    if shape not in _SLOTS:
        if len(_SLOTS) > 200_000:
            _SLOTS.clear()
        short = bytes(c for i, c in enumerate(shape) if i < 2 or not c == shape[i - 1] == shape[i - 2])
        _SLOTS[shape] = DENSE + zlib.crc32(short) % HASHED
    return _SLOTS[shape]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text's features; empty if it has no words."""
    raw = (text or "").encode()
    shaped = raw.translate(_CLASS)
    shapes, words = shaped.split(), raw.split()
    n = len(shapes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    count: dict[bytes, int] = {}
    for s in shapes:
        count[s] = count.get(s, 0) + 1
    places: dict[int, float] = {}
    for s, c in count.items():
        k = _slot(s)
        places[k] = places.get(k, 0) + c
    size = len(raw)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    pairs = list(zip(words, words[1:], strict=False))
    lower, upper, digit, space = (shaped.count(c) / size for c in (b"a", b"A", b"0", b" "))
    lines = raw.count(b"\n") + 1
    dense = [1.0, lower, upper, digit, space, 1 - lower - upper - digit - space, same, len(set(words)) / n, len(set(pairs)) / max(1, len(pairs)), min(size / n / 20, 2), math.log1p(n) / 10, min(lines / n * 5, 2), sum(w.isalnum() for w in words) / n, raw.count(b".") / n]
    at = np.array([*range(DENSE), *places], np.int64)
    return at, np.array([*dense, *(math.sqrt(v / n) for v in places.values())])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, *, rounds: int = 300, ridge: float = 2e-5) -> np.ndarray:
    """Weights of a logistic model by full gradients with adaptive steps."""
    at, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    share = good.mean()
    weight = np.where(good == 1, 0.5 / share, 0.5 / (1 - share)) / len(rows)
    w, seen, move = np.zeros(WIDTH), np.zeros(WIDTH), np.zeros(WIDTH)
    for i in range(1, rounds + 1):
        score = np.bincount(row, w[at] * value, len(rows))
        slope = weight * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - good)
        g = np.bincount(at, slope[row] * value, WIDTH) + ridge * w
        move = 0.9 * move + 0.1 * g
        seen = 0.999 * seen + 0.001 * g * g
        w -= 0.1 * (move / (1 - 0.9**i)) / (np.sqrt(seen / (1 - 0.999**i)) + 1e-9)
    return w


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 12_000) -> np.ndarray | None:
    """Weights from labelled documents; None if the labels have one kind only."""
    ship(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id"))
    known = known.agg(F.min(label_col).alias("l_good"), F.max(label_col).alias("l_max")).where("l_good = l_max")
    # ids first, so that only the chosen documents' texts are moved
    chosen = docs.select(F.col(id_col).alias("d_id")).distinct().join(known, F.col("d_id") == F.col("l_id")).select("l_id", "l_good")
    chosen = materialize(chosen.orderBy(F.xxhash64("l_id"), "l_id").limit(max_labelled), "labelled")
    picked = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), F.col("d_id") == F.col("l_id")).select("t", "l_good")

    def scan(batches):
        for b in batches:
            rows = [features(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.float64())), b.column(1).cast(pa.int32())], names=["at", "v", "good"])

    got = picked.mapInArrow(scan, "at array<long>, v array<double>, good int").toArrow().to_pydict()
    ordered = sorted(zip(got["at"], got["v"], got["good"], strict=True))  # tasks end in any order
    rows = [(np.array(a, np.int64), np.array(v)) for a, v, _ in ordered]
    good = np.array([g for _, _, g in ordered], np.float64)
    return fit(rows, good) if 0 < good.sum() < len(good) else None


def score(docs: DataFrame, weights: np.ndarray | None, *, text_col: str = "text", out: str = "doc_score") -> DataFrame:
    """All columns and ``out``, the model's probability of a good document."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        w = shared.value

        def one(t):
            at, v = features(t)
            if not len(at):
                return 1e-6
            return 1 - 1e-6 if w is None else 1 / (1 + math.exp(-max(-13.0, min(13.0, float(w[at] @ v)))))

        return texts.map(one).astype("float64")

    return docs.withColumn(out, evidence(F.coalesce(F.col(text_col), F.lit(""))))


def sites(scored: DataFrame) -> tuple[DataFrame, float]:
    """(s_host, s_path, host_posterior, path_posterior) and the global mean, from (host, path, p) of all documents."""
    by_path = materialize(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "site-sums")
    by_host = by_path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))

    def strength(groups: DataFrame, mean, total: float, noise: float) -> float:
        """Prior size of a beta: by how much group means differ beyond what their sizes explain."""
        r = groups.agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) ** 2), F.count(F.lit(1)), F.sum(F.col("n").cast("double") ** 2)).first()
        spread, k, squares = float(r[0] or 0), r[1] or 0, float(r[2] or 0)
        if k < 2 or total <= 0 or total - squares / total <= 0:
            return 100.0
        between = max((spread - (k - 1) * noise) / (total - squares / total), 1e-9)
        return min(max(noise / between, 2.0), 1e6)

    t = by_path.agg(F.sum("n"), F.sum("s"), F.sum("q"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")), F.count(F.lit(1))).first()
    total = float(t[0] or 0)
    if not total:
        return by_path.select(F.col("host").alias("s_host"), F.col("path").alias("s_path"), F.lit(0.5).alias("host_posterior"), F.lit(0.5).alias("path_posterior")), 0.5
    mean = min(max(t[1] / total, 1e-3), 1 - 1e-3)
    noise = max(t[3] / max(1.0, total - t[4]), 1e-9)
    m_host = strength(by_host, mean, total, noise)
    hosts = by_host.select(F.col("host").alias("h_host"), ((F.col("s") + m_host * mean) / (F.col("n") + m_host)).alias("host_posterior"))
    joined = by_path.join(hosts, F.col("host").eqNullSafe(F.col("h_host")))
    m_path = strength(joined, F.col("host_posterior"), total, noise)
    path = (F.col("s") + m_path * F.col("host_posterior")) / (F.col("n") + m_path)
    return joined.select(F.col("host").alias("s_host"), F.col("path").alias("s_path"), "host_posterior", path.alias("path_posterior")), mean


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5, max_labelled: int = 12_000) -> DataFrame:
    """All columns of ``docs`` and doc_score, host_posterior, path_posterior, posterior, keep."""
    spark = docs.sparkSession
    added = ("doc_score", "host_posterior", "path_posterior", "posterior", "keep")
    own = [c for c in docs.columns if c not in added]
    weights = train(docs, labels, id_col=id_col, text_col=text_col, max_labelled=max_labelled)
    light = score(docs.select(F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.col(text_col).alias("t")), weights, text_col="t", out="p")
    table, mean = sites(light.select("host", "path", "p"))
    table = materialize(table.select(*[F.col(c).alias("__q_" + c) for c in table.columns]), "sites")
    if table.count() <= BROADCAST_SITES:
        table = F.broadcast(table)
    scored = score(docs.select(*own), weights, text_col=text_col)
    joined = scored.join(table, F.col(host_col).eqNullSafe(F.col("__q_s_host")) & F.col(path_col).eqNullSafe(F.col("__q_s_path")), "left")
    logit = lambda p: F.log(p / (1 - p))
    inside = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = logit(inside(F.col("doc_score"))) - F.lit(math.log(mean / (1 - mean))) + logit(inside(F.coalesce("__q_path_posterior", F.lit(mean))))
    posterior = 1 / (1 + F.exp(-odds))
    host = F.coalesce("__q_host_posterior", F.lit(mean)).alias("host_posterior")
    path = F.coalesce("__q_path_posterior", F.lit(mean)).alias("path_posterior")
    return joined.select(*own, "doc_score", host, path, posterior.alias("posterior"), (posterior >= threshold).alias("keep"))
