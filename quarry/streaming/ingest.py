"""Incremental ingest: deduplication across runs, and index blocks that are merged later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import dedup_key
from quarry.operators.index import Index, build, corpus_stats


def dedup_stream(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys (normalised) that a stream has not shown before. The state holds every key seen and has no bound,
    as what must be remembered has none; streams with times can use ``dropDuplicatesWithinWatermark``."""
    return rows.select(*[dedup_key(F.col(k)).alias(k) for k in keys]).dropDuplicates(list(keys))


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what is new since the last run to Parquet at ``path``."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(
        availableNow=True).start().awaitTermination()


def index_blocks(docs: DataFrame, path: str, checkpoint: str) -> None:
    """Appends each micro-batch's postings and lengths as a block."""
    def block(batch: DataFrame, number: int) -> None:
        part = build(batch)
        part.postings.withColumn("block", F.lit(number)).write.mode("append").parquet(f"{path}/postings")
        part.doc_stats.withColumn("block", F.lit(number)).write.mode("append").parquet(f"{path}/doc_stats")

    docs.writeStream.foreachBatch(block).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merged_blocks(spark: SparkSession, path: str) -> Index:
    """The index of all blocks."""
    postings, docs = spark.read.parquet(f"{path}/postings").drop("block"), spark.read.parquet(f"{path}/doc_stats").drop("block")
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return Index(postings, terms, docs, corpus_stats(docs, terms))
