"""Documents to packed training sequences: filter, deduplicate, mix, pack.

The near-duplicate stage links documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more; one
document of each group, that with the smallest id, stays.

Every stage takes a table with the columns of ``documents`` and possibly others, whatever their names, and returns all
of them; an empty table gives an empty one. Rows that repeat an id are documents each until exact dedup. Null ids stay
where nothing else decides (exact dedup keeps a text once, the near-duplicate stage a group once).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.llm import exact, mixing, packing, quality, queries, similar
from lumenfold.session import materialize, table

#: Words that a packing worker keeps: it stays beside the other stages' workers.
PACKING_WORDS = 150_000


def _renamed(docs):
    """``docs`` with columns c0, c1, ... and the new name of each, so that no stage's own column clashes with one."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*own), dict(zip(docs.columns, own, strict=True))


def filter_quality(spark, docs, sf_dir):
    """Documents that the classifier rejects go; a null or empty text is rejected; without labels of both kinds every
    document with a word stays."""
    rows, name = _renamed(docs)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias(name["doc_id"]), "quality")
    found = quality.classify(rows, labels, id_col=name["doc_id"], text_col=name["text"], host_col=name["source"], path_col=name["lang"])
    return found.where("keep").select(*rows.columns).toDF(*docs.columns)


def drop_exact_copies(spark, docs, sf_dir):
    """Of equal texts (null is empty) the row with the largest id stays; of rows that repeat that id too, one."""
    return exact.survivors(docs)


def drop_near_copies(spark, docs, sf_dir):
    """Of documents linked by similarity, through others too, that with the smallest id stays; texts without a word are
    alike to each other only."""
    return similar.survivors(docs, percent=80, width=5)


def mix_sources(spark, docs, sf_dir):
    """Each document as often as its source's share asks, from not at all to three times; a text without a word follows
    its source's whole repetitions; a null source is the last one."""
    rows, name = _renamed(docs)
    mixed = mixing.mix(rows, id_col=name["doc_id"], text_col=name["text"], source_col=name["source"])
    return mixing.repeat(mixed).select(*rows.columns).toDF(*docs.columns)


def pack_sequences(spark, docs, sf_dir):
    """The pieces of every document with their sequence and place; a null or empty text is one piece of one id."""
    return packing.pack(docs, queries.tokenizer(queries.REMOTE_TOKENIZERS["packing"]), cache_words=PACKING_WORDS)


STAGES = [
    ("quality classifier", filter_quality),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A fitted classifier and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
