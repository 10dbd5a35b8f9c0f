"""Registered queries of the numbered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracle
from .best_fit_packing import best_fit_packing
from .common import read
from .decontamination import benchmark_hits
from .jaccard_join import jaccard_join
from .line_dedup import line_dedup
from .merkle import documents_manifest
from .nearest import nearest
from .quality import quality_scores
from .quotations import conversations
from .secret_scan import digest, secret_scan
from .simhash_dedup import digest as fingerprint_digest
from .simhash_dedup import simhash_groups
from .suffix_dedup import suffix_dedup
from .toxicity import toxicity_scores
from .whitening import whiten


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark, sf):
    found = suffix_dedup(read(spark, sf, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op2_line_dedup(spark, sf):
    return line_dedup(read(spark, sf, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op3_ngram_jaccard_join(spark, sf):
    return jaccard_join(read(spark, sf, "documents")).drop("row_text")


def op4_secret_scan(spark, sf):
    return digest(secret_scan(read(spark, sf, "documents")))


def op5_quality_classifier(spark, sf):
    return quality_scores(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op6_nearest_neighbours(spark, sf):
    return nearest(read(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_chat_formatting(spark, sf):
    return conversations(read(spark, sf, "conversations"))


def op8_toxicity(spark, sf):
    return toxicity_scores(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op9_decontamination(spark, sf):
    return benchmark_hits(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


def op10_best_fit_packing(spark, sf):
    return best_fit_packing(read(spark, sf, "documents"), tokenizer_path())


def op11_merkle_manifest(spark, sf):
    return documents_manifest(read(spark, sf, "documents"))


def op12_embedding_whitening(spark, sf):
    return whiten(read(spark, sf, "embeddings"))


def op13_simhash_dedup(spark, sf):
    return fingerprint_digest(simhash_groups(read(spark, sf, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_line_dedup, op3_ngram_jaccard_join, op4_secret_scan, op5_quality_classifier,
        op6_nearest_neighbours, op7_chat_formatting, op8_toxicity, op9_decontamination, op10_best_fit_packing,
        op11_merkle_manifest, op12_embedding_whitening, op13_simhash_dedup,
    )
}
ORACLE = oracle.ORACLE
