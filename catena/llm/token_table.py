"""Token ids as Parquet list columns.

A token table is a folder with two Parquet tables. ``tokens`` has one row per
document in ascending order of its id: doc_id, file, at, n_tokens and ids, a
list column. Its files are ranges of doc_id, sorted within; ids are dictionary-
encoded, or delta-encoded where a column chunk's dictionary outgrows its page
limit (writer version 2 falls back to DELTA_BINARY_PACKED), and compressed.
Row groups and pages have set sizes, and pages carry column and offset indexes,
so that a filter on doc_id reads few pages, and a query of the metadata none of
the ids. ``files`` has one row per file with the ids before it; a document's
start is that plus at, its place within the file.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catena.llm.common import shuffle_partitions, skew_join
from catena.llm.pieces import library_encoder

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
DICTIONARY_PAGE_BYTES = 1 << 20
#: Documents that a worker holds the ids of at a time.
ROWS = 256


def _encoded(tokenizer: str, end_id: int, lead: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (doc_id, file, text) of one range partition in order, rows of the table: ids as lists, with their place in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(tokenizer, lead)
        tail = np.array([end_id], "<u4").tobytes()
        at = 0
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                ids = [encode(t.as_py()) + tail for t in part.column(2)]
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(at + ends - counts), pa.array(counts), lists], ["doc_id", "file", "at", "n_tokens", "ids"])
                at += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, lead: str = "", id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write a token table at path, a folder that Spark can reach.

    Texts are dealt into ranges of doc_id and sorted first, so that encoding
    and writing are one pass. Null texts count as empty and have end_id alone.
    Repeated rows are written as often, a null id comes first; an empty table
    makes an empty one. Other columns are not read.
    """
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # The salt deals repeats of one id over ranges.
    rows = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id").select("doc_id", F.spark_partition_id().alias("file"), "text")
    (
        rows.mapInArrow(_encoded(tokenizer, end_id, lead), "doc_id long, file int, at long, n_tokens long, ids array<int>")
        .write.option("parquet.writer.version", "v2")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.dictionary.page.size", DICTIONARY_PAGE_BYTES)
        .option("parquet.enable.dictionary", "true")
        .option("compression", "zstd")
        .parquet(f"{path}/tokens")
    )
    spark = docs.sparkSession
    sizes = spark.read.parquet(f"{path}/tokens").groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).write.parquet(f"{path}/files")


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and, unless left out, ids of a token table; filters on doc_id prune files and pages."""
    rows = spark.read.parquet(f"{path}/tokens")
    rows = rows if ids else rows.drop("ids")
    return skew_join(rows, spark.read.parquet(f"{path}/files"), "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", *(["ids"] if ids else []))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: the crc32 of the ids as little-endian unsigned 32-bit integers.

    Checksums are taken where the ids are read, and only they are joined with the files' starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            ends = lists.offsets.to_numpy()
            raw = lists.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], ["doc_id", "file", "at", "n_tokens", "ids_crc32"])

    rows = spark.read.parquet(f"{path}/tokens").select("doc_id", "file", "at", "n_tokens", "ids").mapInArrow(run, "doc_id long, file int, at long, n_tokens long, ids_crc32 long")
    return skew_join(rows, spark.read.parquet(f"{path}/files"), "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
