"""Vectors as codes: product codebooks by Lloyd's rounds with Hamerly's bounds, in whole numbers.

A component x becomes floor(``scale`` * x); a vector is cut into ``parts`` equal parts, each with a codebook of its own.
Every vector keeps, written to the shared folder between rounds, its entry and two bounds for each part: ``upper``, no
less than the distance to its entry, and ``lower``, no more than the distance to any other. When entries move, upper
grows by its entry's move and lower shrinks by the largest move of the others. Where upper is strictly less than
lower, no other entry can be nearest or tie, and the part is done; else upper is made exact, and only if it is still not
less are all entries measured, in whole numbers, ties to the lower index. Bounds are widened by more than the rounding
of the doubles that hold them. A round's sums are added up in each task and then by (part, entry, position), so what
is shuffled and what the driver takes is as large as the codebooks, whatever the data.

Defined cases: vectors that are null or hold a null or a non-finite component take no part; ids and labels may be null (a
null id sorts last, null labels are one label); of equal ids the smaller vector comes first; repeated rows count each;
vectors shorter than the longest, or than a multiple of ``parts``, are filled with zeros at their end; fewer vectors than
entries make a smaller codebook; numbers beyond a long are computed as whole numbers of any size, and an error
beyond a long is the largest long; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.session import materialize, ship

LONGEST = 2**63 - 1
#: Widening of a bound at each use: far over the rounding of a double, far under what a bound decides.
SLACK = 1e-12
LIMB = 40
#: Labels whose sums are told by broadcast; more are joined by shuffle.
BROADCAST_LABELS = 100_000
STATE = "vec_id {0}, label {1}, v array<double>, code binary, upper binary, lower binary"


def whole(values: np.ndarray, scale: int, parts: int, width: int) -> np.ndarray:
    """(n, parts, width) floors of ``scale`` times the values: longs if no distance can pass one, else Python integers."""
    with np.errstate(over="ignore"):
        found = np.floor(values * float(scale))
    if not found.size or np.abs(found).max() * 2 < (LONGEST / max(width, 1)) ** 0.5 / 2:
        out = found.astype(np.int64)
    else:
        out = np.array([int(f) if np.isfinite(f) else scale * int(x) for f, x in zip(found.ravel(), values.ravel(), strict=True)], object)
    return out.reshape(len(values), parts, width)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(n, entries) squared distances, exact: longs if both sides are, else Python integers."""
    if x.dtype == object or book.dtype == object:
        d = x.astype(object)[:, None, :] - book.astype(object)[None]
        return (d * d).sum(2) if d.shape[2] else np.zeros(d.shape[:2], object)
    d = x[:, None, :] - book[None]
    return np.einsum("nkw,nkw->nk", d, d)


def _scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper, lower): the nearest entry, the least index of a tie, and the bounds; none can be known of Python integers."""
    code, upper, lower = np.empty(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x))
    for s in range(0, len(x), 4096):
        d = distances(x[s : s + 4096], book)
        at = d.argmin(1)
        code[s : s + 4096] = at
        if d.dtype != object:
            rows = np.arange(len(d))
            upper[s : s + 4096] = np.sqrt(d[rows, at]) * (1 + SLACK)
            d[rows, at] = LONGEST
            lower[s : s + 4096] = np.sqrt(d.min(1)) * (1 - SLACK) if len(book) > 1 else np.inf
    return code, upper, lower


def _own(x: np.ndarray, book: np.ndarray, code: np.ndarray) -> np.ndarray:
    if x.dtype == object or book.dtype == object:
        x, book = x.astype(object), book.astype(object)
    d = x - book[code]
    return (d * d).sum(1)


def _assign(x: np.ndarray, book: np.ndarray, before, moved: np.ndarray | None):
    """(entry, upper, lower) of one part's vectors; ``before`` has them of the last round, ``moved`` how far each entry went."""
    if moved is None:
        return _scan(x, book)
    code, upper, lower = before
    order = np.argsort(moved)
    others = np.full(len(moved), moved[order[-1]])  # the largest move among the other entries
    others[order[-1]] = moved[order[-2]] if len(moved) > 1 else 0.0
    upper, lower = (upper + moved[code]) * (1 + SLACK), lower - others[code]
    lower -= np.abs(lower) * SLACK
    with np.errstate(invalid="ignore"):
        fail = np.flatnonzero(~(upper < lower))
        if len(fail) and x.dtype != object and book.dtype != object:
            upper[fail] = np.sqrt(_own(x[fail], book, code[fail])) * (1 + SLACK)
            fail = fail[~(upper[fail] < lower[fail])]
    if len(fail):
        code[fail], upper[fail], lower[fail] = _scan(x[fail], book)
    return code, upper, lower


def _values(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of ``dims`` doubles, filled with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def _moves(old: np.ndarray, new: np.ndarray) -> np.ndarray | None:
    """How far each entry went, no less; None if that is beyond doubles."""
    if old.dtype == object or new.dtype == object:
        return None
    return np.sqrt(((new - old).astype(float) ** 2).sum(2)) * (1 + SLACK)


def _sums(state: DataFrame, shape: tuple[int, int, int], scale: int) -> list:
    """Rows (part, entry, pos, limb, total): the sums of the parts of each entry, in limbs; at pos -1 their count."""
    parts, entries, width = shape

    def scan(batches):
        small, large, count = np.zeros((parts, entries, width), np.int64), defaultdict(int), np.zeros((parts, entries), np.int64)
        for b in batches:
            x = whole(_values(b.column(0), parts * width), scale, parts, width)
            code = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(len(x), parts)
            for p in range(parts):
                count[p] += np.bincount(code[:, p], minlength=entries)
                if x.dtype != object:
                    np.add.at(small[p], code[:, p], x[:, p])
                    continue
                for e, row in zip(code[:, p].tolist(), x[:, p], strict=True):
                    for w, value in enumerate(row):
                        large[p, e, w] += value
        rows = [(int(p), int(e), -1, 0, int(count[p, e])) for p, e in zip(*np.nonzero(count), strict=True)]
        for p, e, w in {*zip(*(c.tolist() for c in np.nonzero(small)), strict=True), *large}:
            value, limb = int(small[p, e, w]) + large.get((p, e, w), 0), 0
            while value:
                low = value if abs(value) < 1 << LIMB else value & (1 << LIMB) - 1
                rows.append((p, e, w, limb, low))
                value, limb = (value - low) >> LIMB, limb + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["part", "entry", "pos", "limb", "total"])

    found = state.select("v", "code").mapInArrow(scan, "part long, entry long, pos long, limb long, total long")
    return found.groupBy("part", "entry", "pos", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # as large as the codebooks


def _means(books: np.ndarray, rows: list) -> np.ndarray:
    total, count = defaultdict(int), {}
    for r in rows:
        if r["pos"] < 0:
            count[r["part"], r["entry"]] = int(r["total"])
        else:
            total[r["part"], r["entry"], r["pos"]] += int(r["total"]) << LIMB * r["limb"]
    new = books.astype(object)
    for (p, e), n in count.items():
        for w in range(new.shape[2]):
            new[p, e, w] = total[p, e, w] // n
    return _small(new)


def _small(books: np.ndarray) -> np.ndarray:
    most = max((abs(int(x)) for x in books.ravel()), default=0)
    return books.astype(np.int64) if most * 2 < (LONGEST / max(books.shape[2], 1)) ** 0.5 / 2 else books


def kept(vectors: DataFrame, *, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & fine).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))


def compress(vectors: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Codes (vec_id, label, codes array<int>, error) and the final codebooks, (parts, entries, width) of whole numbers."""
    spark = vectors.sparkSession
    ship(spark)
    rows = kept(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-dims // parts)
    first = rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    found = f"vec_id {kinds[0]}, label {kinds[1]}, codes array<int>, error long"
    if not first:
        return spark.createDataFrame([], found), np.zeros((parts, 0, width), np.int64)
    start = _values(pa.array([r["v"] for r in first], pa.list_(pa.float64())), parts * width)
    books = _small(whole(start, scale, parts, width).transpose(1, 0, 2))

    def pass_over(state: DataFrame, moved: np.ndarray | None, last: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast((books, moved))  # as large as the codebooks

        def scan(batches):
            books, moved = shared.value
            for b in batches:
                n = b.num_rows
                x = whole(_values(b.column(2), parts * width), scale, parts, width)
                code, upper, lower = np.zeros((n, parts), np.int64), np.empty((n, parts)), np.empty((n, parts))
                if moved is not None:
                    code = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint16).reshape(n, parts).astype(np.int64)
                    upper, lower = (np.frombuffer(b"".join(b.column(c).to_pylist())).reshape(n, parts).copy() for c in (4, 5))
                for p in range(parts):
                    code[:, p], upper[:, p], lower[:, p] = _assign(x[:, p], books[p], (code[:, p].copy(), upper[:, p], lower[:, p]), None if moved is None else moved[p])
                if last:
                    error = sum(_own(x[:, p], books[p], code[:, p]).astype(object) for p in range(parts))
                    error = [min(int(e), LONGEST) for e in error] if n else []
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(code.astype(np.int32)), pa.list_(pa.int32())), pa.array(error, pa.int64())], names=["vec_id", "label", "codes", "error"])
                    continue
                packed = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (code.astype(np.uint16), upper, lower)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *packed], names=["vec_id", "label", "v", "code", "upper", "lower"])

        return state.mapInArrow(scan, found if last else STATE.format(*kinds))

    state, moved = rows, None
    for _ in range(rounds):
        state = materialize(pass_over(state, moved, False), "codes")
        new = _means(books, _sums(state, books.shape, scale))
        books, moved = new, _moves(books, new)
    return pass_over(state, moved, True), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def report(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each vector that takes part."""
    codes, books = compress(vectors, **options)
    codes = materialize(codes, "compressed")
    most = F.lit(LONGEST).cast("decimal(38,0)")
    labels = materialize(codes.groupBy(F.col("label").alias("l_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error")), "label-errors")
    labels = F.broadcast(labels) if labels.count() <= BROADCAST_LABELS else labels.hint("merge")
    hexed = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return codes.join(labels, F.col("label").eqNullSafe(F.col("l_label"))).select("vec_id", hexed.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    ctes = [
        f"k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        f"p AS (SELECT k.vec_id, t.part, v[t.part * (len(v) // {parts}) + 1 : (t.part + 1) * (len(v) // {parts})] AS x FROM k, range({parts}) t(part))",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < {entries})",
        "c0 AS (SELECT part, entry, x FROM p JOIN f USING (vec_id))",
    ]
    apart = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS (SELECT vec_id, part, min({{'d': {apart}, 'entry': c.entry}}) AS best FROM p JOIN c{r} c USING (part) GROUP BY vec_id, part)")
        if r < rounds:
            # floor division of whole numbers
            ctes.append(
                f"m{r} AS (SELECT part, entry, pos, (s - ((s % n) + n) % n) // n AS y FROM (SELECT a.part, a.best.entry AS entry, u.pos, sum(p.x[u.pos]) AS s, count(*) AS n"
                f" FROM a{r} a JOIN p USING (vec_id, part), unnest(range(1, len(p.x) + 1)) u(pos) GROUP BY ALL))"
            )
            ctes.append(f"n{r} AS (SELECT part, entry, list(CAST(y AS BIGINT) ORDER BY pos) AS x FROM m{r} GROUP BY part, entry)")
            ctes.append(f"c{r + 1} AS (SELECT c.part, c.entry, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN n{r} n USING (part, entry))")
    ctes.append(f"w AS (SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)")
    ctes.append(f"h AS (SELECT sha256(string_agg(CAST(u.y AS VARCHAR), ',' ORDER BY part, entry, u.i)) AS s FROM (SELECT part, entry, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM c{rounds}) u)")
    return "WITH " + ", ".join(ctes) + " SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT s FROM h) AS codebooks_sha256 FROM k JOIN w USING (vec_id)"


SQL = _sql()
