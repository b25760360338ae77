"""The registered queries of this subpackage, with their production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.llm import codes, exact, html, jaccard, lm, mixing, packing, pii, quality, records, simhash, topk, trie
from lumenfold.session import new_path, table

#: The key of the surrogates; a deployment passes its own secret.
SURROGATE_KEY = b"an example key, not a secret"
REMOTE_TOKENIZERS = {"records": "byte_bpe_50k.json", "packing": "word_bpe_49k.json"}


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_pii(spark, sf_dir):
    return pii.pseudonymize(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op3_html(spark, sf_dir):
    return html.main_text(table(spark, sf_dir, "pages"))


def op4_records(spark, sf_dir):
    out = new_path(spark, "token-records")
    manifest = records.write(table(spark, sf_dir, "documents"), out, tokenizer(REMOTE_TOKENIZERS["records"]))
    return records.read(spark, out, manifest)


def op5_quality(spark, sf_dir):
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "doc_score", "host_posterior", "path_posterior", "posterior", "keep")


def op6_lm(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact(spark, sf_dir):
    return exact.groups(table(spark, sf_dir, "documents"))


def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(REMOTE_TOKENIZERS["packing"]))


def op10_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_codes(spark, sf_dir):
    return codes.report(table(spark, sf_dir, "embeddings"))


def op12_jaccard(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"))


def op13_trie(spark, sf_dir):
    return trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_pii, op3_html, op4_records, op5_quality, op6_lm, op7_exact, op8_simhash, op9_packing, op10_topk, op11_codes, op12_jaccard, op13_trie)}
SQL = {"op7_exact": exact.SQL, "op10_topk": topk.SQL, "op11_codes": codes.SQL, "op13_trie": trie.SQL}
