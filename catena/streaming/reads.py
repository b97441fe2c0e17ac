"""Reads as a stream: files that arrive are mapped batch by batch, with running counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_reads(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Reads (name, seq) of FASTA files with two lines a record, as they arrive; some files at a time bound a batch."""
    raw = spark.readStream.option("lineSep", ">").option("maxFilesPerTrigger", files).text(path).where("trim(value) <> ''")
    parts = F.split("value", "\n")
    return raw.select(F.split_part(F.element_at(parts, 1), F.lit(" "), F.lit(1)).alias("name"), F.upper(F.trim(F.element_at(parts, 2))).alias("seq"))


def counts(reads: DataFrame) -> DataFrame:
    """Running numbers of reads and bases: the only state there is."""
    return reads.agg(F.count(F.lit(1)).alias("reads"), F.sum(F.length("seq")).alias("bases"))


def map_stream(reads: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each batch with read ids to batch (one that maps and writes it), once each if its sink is idempotent by number."""

    def run(df: DataFrame, number: int) -> None:
        batch(df.withColumn("read_id", F.xxhash64("name")), number)

    return reads.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
