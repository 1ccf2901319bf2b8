"""The queries opN_<name> of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import media, packing, pieces, quality, repeats, sharding, simhash, spherical, toxicity, warc
from .labelled import remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = media.text_media(_table(spark, sf_dir, "documents"))
    return made.withColumn("tile_sha256", F.sha2("tile", 256)).drop("tile")


def _classified(scored: DataFrame, modulus: int, held: int, threshold: float) -> DataFrame:
    return scored.select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    weights = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return _classified(toxicity.score_texts(docs, weights), 3, 1, 0.7)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return _classified(quality.score_texts(docs, model), 5, 0, 0.3)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(_table(spark, sf_dir, "pages")))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sampled_pieces(_table(spark, sf_dir, "documents"), keep_ids=False)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked")


def op7_spherical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns at 400 bytes; passage_text and n_passage_bytes for passages of over fifty words."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return repeats.remove_repeats(docs, keep=("kept_text",), passage=repeats.PASSAGE)


QUERIES = {
    "op1_media": op1_media,
    "op2_warc": op2_warc,
    "op3_simhash": op3_simhash,
    "op4_packing": op4_packing,
    "op5_pieces": op5_pieces,
    "op6_sharding": op6_sharding,
    "op7_spherical": op7_spherical,
    "op8_toxicity": op8_toxicity,
    "op9_repeats": op9_repeats,
    "op10_quality": op10_quality,
}
ORACLE_SQL: dict[str, str] = {"op2_warc": warc.oracle_sql()}
