"""Bounded training samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null ids have none."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(divisor)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, use: Column, max_rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``max_rows`` labelled documents, the first by a hash of the id.

    The rows are chosen in the labels table alone (a distributed top-k), so what is broadcast to the
    documents holds at most ``max_rows`` ids and labels. Labels other than 0 and 1 are left out; of
    repeated labels of a document the largest counts, of several texts with one id the first by hash.
    """
    chosen = (
        labels.filter(F.col(label).isin(0, 1) & use & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("doc_id"))
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    text = F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), "text")).getField("text")
    return rows.groupBy("doc_id").agg(text.alias("text"), F.min("label").alias("label"))
