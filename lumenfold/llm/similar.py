"""Near copies by SimHash and by the similarity of their shingle sets, decided exactly.

Two documents are linked if the Jaccard similarity of their sets of word shingles is at least ``percent`` hundredths. Links
are proposed in two ways, and the exact sets of both documents decide every one:

* by SimHash fingerprints within 3 bits, found in vantage-point trees (``simhash.near_edges``);
* by the lists and subsets of the exact join (``jaccard``), for what fingerprints leave: at a similarity of 0.8 two
  fingerprints differ in some 10 of 64 bits, 17 at worst, and no tree prunes a search of that radius, since unlike ones
  differ in 32, give or take 4. No link between different sets is lost.

Defined cases: a null or empty text, or one without words, has the empty set and is alike only to others of that kind;
fewer words than a shingle give one shingle; repeated rows share everything; ids may be null (a null id is never a
component's smallest unless all are null); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import jaccard, simhash
from lumenfold.session import materialize


def near_copies(docs: DataFrame, *, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) for each row of ``docs``; component_id is the smallest id reachable by links."""
    how = jaccard.plan(docs, text_col, width, percent)
    every = materialize(jaccard.sketches(docs, how, id_col, text_col, width, percent, prints=True), "sketches")
    nodes = every.groupBy("node").agg(F.min("id").alias("least"), F.min("mark").alias("mark"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("fp").alias("fp"))
    nodes = materialize(nodes, "sets")
    # sets of one fingerprint are held against its first, and that against those of near fingerprints
    led = materialize(nodes.where("n > 0").groupBy("fp").agg(F.min("node").alias("led")), "fingerprints")
    side = lambda k: led.select(F.col("fp").alias(f"{k}_fp"), F.col("led").alias(f"{k}_led")).hint("merge")
    near = simhash.near_edges(led.select("fp")).join(side("a"), F.col("a") == F.col("a_fp")).join(side("b"), F.col("b") == F.col("b_fp")).select(F.col("a_led").alias("a"), F.col("b_led").alias("b"))
    same = nodes.where("n > 0").select("node", "fp").join(side("a"), F.col("fp") == F.col("a_fp")).where("node <> a_led").select(F.col("node").alias("a"), F.col("a_led").alias("b"))
    base = jaccard.linked(docs, nodes, every, how[2], percent, text_col, width, near.unionByName(same))
    return jaccard.named(every, nodes, base).select(F.col("id").alias(id_col), "component_id")


def survivors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the smallest of their component; of repeated rows, one."""
    return simhash.representatives(docs, near_copies(docs, id_col=id_col, text_col=text_col, **options), id_col)
