"""From raw documents to packed training sequences: five stages over the operators of larkspur.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of
`documents`. Stages filter rows where they lie, so texts are moved only by the near-dedup join and into
the packets of the repeat removal.

Defined results of all stages: a null text is scored, compared and packed as an empty one; texts of any
length are used whole; rows without an id, and rows that share one, are rows of their own (labels find
all rows of their id); of equal rows that are all that is left of a group one stays, which one being
decided by id, then by row; an empty table stays empty; all columns of the table come through the first
four stages as they are, but for `text` and `n_chars` of the fourth, and the last has its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.llm import packing, quality, repeats, simhash, toxicity
from larkspur.llm.common import cut, scratch_released


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking rejects go."""
    return quality.accepted(docs, quality.fit(docs, _labels(spark, sf_dir)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.accepted(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, with a doc_id if any has one."""
    return simhash.representatives(docs, unnamed=True)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of a string of repeats.PASSAGE bytes that starts anywhere else goes; documents stay, shorter or empty.

    The width is that of a passage of fifty words, not the 400 bytes of op9: prose of just over fifty
    words has fewer bytes than that.
    """
    cleaned = repeats.remove_repeats(docs, width=repeats.PASSAGE, keep=("kept_text",))
    return cleaned.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long")).select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 tokens, filled as far as can be."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("repeats", cut_repeats),
    ("packing", pack),
]

#: Trained models, fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again before the next; a stage's scratch tables go once it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch_released(spark) as keep:
            docs, path = cut(stage(spark, docs, sf_dir), f"stage-{name}")
            keep.append(path)
    return STAGES[-1][1](spark, docs, sf_dir)
