"""Labels that may be learnt from, and the texts that have them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def known(labels: DataFrame, label: str, modulus: int, held: int) -> DataFrame:
    """(doc_id, y) of all labelled ids that are not held out; null ids and labels are left out, and an id labelled twice counts once, with its larger label."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (remainder(F.col("doc_id"), modulus) != held))
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))


def texts_of(docs: DataFrame, some: DataFrame, modulus: int, held: int, max_bytes: int) -> DataFrame:
    """(o, y, text) of all rows whose id is in some = known(...), o being a hash of the id.

    Labelled texts of more than max_bytes are not trained on (they are scored like any other). Rows that
    share an id are all there. The hint makes tables of any size meet by id, without a broadcast.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), modulus) != held) & (F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes))
    return texts.join(some.hint("merge"), "doc_id").select(F.xxhash64("doc_id").alias("o"), "y", "text")
