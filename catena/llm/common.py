"""What the operators of this subpackage share: tables, shared storage, skew-safe joins."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; a cluster
    without it is an error, as executors would not see the driver's folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="catena-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Rows that travel to a Python worker at a time; ten thousand texts would be held several times over, on both sides.
BATCH_ROWS = 2048


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """What is planned and run meanwhile has these settings."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _written(df: DataFrame, path: str) -> DataFrame:
    """df as a table in path. Its shuffle files go when it is written, as nothing reads them again."""
    spark, schema = df.sparkSession, df.schema
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(batch, "0"))
    rows = rows if 0 < rows < BATCH_ROWS else BATCH_ROWS
    with _settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", batch: str(rows)}):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def saved(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage and outlives lost executors.

    The table stays; for what only an operator itself reads there is Scratch.
    """
    return _written(df, f"{shared_dir(df.sparkSession)}/catena-{uuid.uuid4().hex}")


class Scratch:
    """Tables in the shared folder that are removed at the end of a with block; no plan that reads them may leave it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, 0
        self.path = f"{shared_dir(spark)}/catena-{uuid.uuid4().hex}"

    def saved(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        return _written(df, f"{self.path}/{self.tables}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        sc = self.spark.sparkContext
        place = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


#: Bits of a bitmap for each key, and bits of the smallest and the largest bitmap (16 MiB).
BITS_A_KEY = 16
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 27
#: Bits in a row of a bitmap, as bitmap_construct_agg makes them.
ROW_BITS = 1 << 15


class KeyBitmap:
    """Keys as a bitmap, sized from their count up to a fixed bound, with one row for each 32,768 slots; broadcast, as it is 16 MiB at most.

    keys are distinct; their columns are the key. What is in the bitmap may be
    no key, by a collision, but no key is missing.
    """

    def __init__(self, keys: DataFrame, own: Scratch):
        self.names = keys.columns
        marked = own.saved(keys.select(F.xxhash64(*self.names).alias("_key")))
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * max(1, marked.count()) - 1).bit_length()))
        slot = self._slot(F.col("_key"))
        rows = marked.select(F.shiftright(slot, 15).alias("_bucket"), slot.bitwiseAND(ROW_BITS - 1).alias("_bit"))
        self.rows = saved(rows.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits")).coalesce(1))

    def _slot(self, key: Column) -> Column:
        return F.pmod(key, F.lit(self.bits))

    def mark(self, rows: DataFrame, into: str) -> DataFrame:
        """rows with a boolean: whether the row's key is in the bitmap."""
        slot = self._slot(F.xxhash64(*self.names))
        place = slot.bitwiseAND(ROW_BITS - 1).cast("int")
        joined = rows.withColumn("_bucket", F.shiftright(slot, 15)).withColumn("_bit", place).join(F.broadcast(self.rows), "_bucket", "left")
        byte = F.expr("cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int)")
        alive = F.coalesce(F.expr("cast(1 as int) << cast(_bit % 8 as int)").bitwiseAND(byte) != 0, F.lit(False))
        return joined.withColumn(into, alive).drop("_bucket", "_bit", "_bits")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on key where left may hold very many rows of one key, right holds one.

    The second key column makes both sides get an exchange of their own, even
    if right was aggregated by key, so that adaptive execution can split a hot
    key's rows on the left over many tasks.
    """
    tag = F.pmod(F.hash(F.col(key)), F.lit(8)).cast("byte")
    return left.withColumn("_jk", tag).join(right.withColumn("_jk", tag), [key, "_jk"], how).drop("_jk")


def hex64(c: Column) -> Column:
    """Sixteen lowercase hex digits of a long's bits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


_caches: list = []


def worker_cache(cached):
    """Register an lru_cache that worker processes keep between tasks."""
    _caches.append(cached)
    return cached


def trim_worker() -> None:
    """Give what this worker process's allocators hold unused back to the system, where they can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free_worker_caches() -> None:
    """Give back what this worker process keeps for operators that ran before; called where another operator needs the memory."""
    for cached in _caches:
        cached.cache_clear()
    trim_worker()


def lean_driver(spark: SparkSession) -> None:
    """Let the driver give back what queries that have ended leave: compiled code, shuffles and broadcasts without a reader, heap.

    Its collector does that only when the heap is full, and an operator of many queries would fill it with them.
    """
    trim_worker()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def lean_worker() -> Iterator[None]:
    """Around the work of a task whose worker process is kept: it starts and ends without memory of other work."""
    free_worker_caches()
    try:
        yield
    finally:
        free_worker_caches()
