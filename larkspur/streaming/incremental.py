"""Incremental maintenance with Structured Streaming: upserts by batch, and an index kept by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery


def replay(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, key: str, order: tuple[str, ...], files_per_batch: int = 16, pattern: str = "*.parquet") -> StreamingQuery:
    """Everything new in the folder `source` (Parquet files of that pattern), appended to `sink` batch by batch with its batch number; each file once.

    Within a batch only the last version of a key is written. A batch that is run again after a failure
    replaces what it had written.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
        last = batch.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
        last.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(source)
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, sink: str, key: str, order: tuple[str, ...]) -> DataFrame:
    """The last version of each key over all batches."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return spark.read.parquet(sink).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "batch")


def watch_markdown(spark: SparkSession, folder: str, checkpoint: str, handle) -> StreamingQuery:
    """Calls handle(files) with new and changed markdown files until stopped."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.md").load(folder)
    return files.writeStream.foreachBatch(lambda df, _: handle(df)).option("checkpointLocation", checkpoint).start()


def updated_postings(postings: DataFrame, removed: DataFrame, added: DataFrame, key: str = "doc_id") -> DataFrame:
    """Postings without those of removed and replaced documents, and with the new ones."""
    gone = removed.select(key).unionByName(added.select(key)).distinct()
    return postings.join(gone, key, "left_anti").select(*added.columns).unionByName(added)
