"""Bounded sample of labelled documents that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, texts

#: Labelled documents that a classifier is fitted on, at most.
SAMPLE = 12_000


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``text`` and ``label`` of at most ``most`` labelled documents outside the held-out fifth.

    The rows are those with the least hash of the id.  A document with labels that differ counts by the least one;
    rows without id or label are left out.  The ids, of a number that the argument bounds, are broadcast.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("labelled"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("labelled").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("labelled")))
    picked = known.groupBy("labelled").agg(F.min("label").alias("label")).orderBy(F.xxhash64("labelled"), "labelled").limit(most)
    rows = texts(docs)
    return rows.join(F.broadcast(picked), rows["doc_id"] == picked["labelled"]).drop("labelled")
