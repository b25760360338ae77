"""Exact duplicates by skew-safe combining.

Equal texts have equal digests, so a digest that occurs once needs no more than its count. Rows of other digests are
combined in three steps that each compare digest and full text: locally (the partial aggregate of each task), by
salted digest (``SALTS`` groups of rows for each digest, so that no task gets all of a hot one), and globally over
the salt groups' winners, of which a text has ``SALTS`` at most. Joins back to the rows compare the full text too
and are plain equi-joins, whose large partitions adaptive execution splits.

Defined cases: a null text counts as empty (and all empty texts are equal); the largest id stays, a null id is less
than any other; of rows that repeat id and text one is kept (the others share its keep_id and group_size); an empty
table gives an empty result. Columns of the input never clash: results are built from id and text, and ``survivors``
returns the input's own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.session import materialize

SALTS = 32


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", F.sha2("text", 256))


def _repeated(base: DataFrame) -> DataFrame:
    """Digests that occur more than once, as a table of their own, so that a join with it can split its other side. It
    grows with the data: the hint keeps its joins the same, by shuffle, at every size."""
    salted = base.groupBy("digest", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(F.count(F.lit(1)).alias("n"))
    digests = salted.groupBy(F.col("digest").alias("d_digest")).agg(F.sum("n").alias("d_n")).where("d_n > 1").select("d_digest")
    return materialize(digests, "repeated-digests").hint("merge")


def _winners(rows: DataFrame) -> DataFrame:
    """(digest, text) -> keep_id, group_size, for rows of digests that occur more than once."""
    salted = F.concat_ws("/", "digest", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("string"))
    by_salt = rows.groupBy(salted.alias("salted"), "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    by_salt = by_salt.withColumn("w_digest", F.substring_index("salted", "/", 1))
    won = by_salt.groupBy("w_digest", F.col("text").alias("w_text")).agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return materialize(won, "winners").hint("merge")  # its own table, so that the join with the copies can split hot ones


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    base = _base(docs, id_col, text_col)
    repeated = _repeated(base)
    alone = base.select("id", "digest").join(repeated, F.col("digest") == F.col("d_digest"), "left_anti")
    alone = alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    many = materialize(base.join(repeated, F.col("digest") == F.col("d_digest")).select("id", "digest", "text"), "copies")
    joined = many.join(_winners(many), (F.col("digest") == F.col("w_digest")) & (F.col("text") == F.col("w_text")))
    # rows that repeat id and text become one row with its count, then as many again, the first of them kept
    same = joined.groupBy("id", "keep_id", "group_size", "digest", F.xxhash64("text").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    place = F.explode(F.sequence(F.lit(1), F.col("n")))
    copies = same.select("id", "keep_id", "group_size", "digest", place.alias("place"))
    copies = copies.select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("place") == 1)).alias("kept"), "digest")
    out = alone.unionByName(copies)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def survivors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]
    key, text = F.col(own[names.index(id_col)]), F.coalesce(F.col(own[names.index(text_col)]), F.lit(""))
    repeated = _repeated(_base(docs, id_col, text_col))
    rows = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)]).withColumn("digest", F.sha2(text, 256))
    alone = rows.join(repeated, F.col("digest") == F.col("d_digest"), "left_anti").select(*own)
    many = materialize(rows.join(repeated, F.col("digest") == F.col("d_digest")).drop("d_digest"), "copies")
    won = _winners(many.select(key.alias("id"), text.alias("text"), "digest"))
    kept = many.join(won, (F.col("digest") == F.col("w_digest")) & (text == F.col("w_text")) & key.eqNullSafe(F.col("keep_id")))
    whole = F.struct(*own)
    one = kept.groupBy("w_digest", "w_text").agg(F.min_by(whole, F.xxhash64(whole)).alias("row")).select("row.*")
    return alone.unionByName(one).toDF(*names)


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
