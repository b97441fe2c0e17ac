"""Seeded simulation of reads: fragments of a digest, put together, with known truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catena.operators.sites import digest

#: Shares of reads with 1, 2, 3 to 5, 6 to 10 and 11 to 15 fragments, in hundredths, and of fragments of 1, 2 and 3 pieces, in tenths.
READ_ORDERS = ((1, 1, 8), (2, 2, 8), (3, 5, 24), (6, 10, 45), (11, 15, 15))
PIECES = ((1, 8), (2, 1), (3, 1))


def draw(key, salt: str, n):
    """A number below n from a hash of key: the same on every engine and run."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("long"), n)


def library(refs: DataFrame, enzyme: str, least: int = 100, most: int = 5000) -> DataFrame:
    """(sid, ord, b, e): stretches of one to three fragments of the digest, of bounded length, without ambiguous bases."""
    f = digest(refs, enzyme)
    at = draw(F.concat_ws("-", "sid", "ord"), "pieces", F.lit(10))
    pieces = F.when(at < 8, 0).when(at < 9, 1).otherwise(2)
    w = Window.partitionBy("sid").orderBy("ord")
    f = f.withColumn("p", pieces).select("sid", "ord", "b", F.coalesce(F.when(F.col("p") == 0, F.col("e")).when(F.col("p") == 1, F.lead("e", 1).over(w)).otherwise(F.lead("e", 2).over(w)), F.col("e")).alias("e"))
    f = f.where((F.col("e") - F.col("b")).between(least, most))
    clean = f.join(refs.select("sid", "seq"), "sid").where(~F.expr("substring(seq, b + 1, e - b)").rlike("[^ACGT]"))
    return clean.select("sid", "ord", "b", "e")


def simulate(refs: DataFrame, enzyme: str, reads: int, seed: str = "1") -> DataFrame:
    """(read_id, header, seq): fragments drawn from the library, in order of (sid, b) within a read.

    A read draws ranks of the library, and ranks are numbers, so the draw is an
    equi-join; a fragment that overlaps the one before it is left out, so that
    even a small library ends.
    """
    lib = library(refs, enzyme)
    lib = lib.withColumn("rank", F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("sid"), F.lit(1))).orderBy("sid", "ord")) - 1)
    n = lib.count()
    if not n:
        return refs.sparkSession.createDataFrame([], "read_id long, header string, seq string")
    ids = refs.sparkSession.range(reads).withColumnRenamed("id", "read_id")
    at, order, below = draw(F.col("read_id"), f"{seed}:order", F.lit(100)), None, 0
    for low, high, share in READ_ORDERS:
        below += share
        size = low + draw(F.col("read_id"), f"{seed}:size", F.lit(high - low + 1))
        order = F.when(at < below, size) if order is None else order.when(at < below, size)
    picks = ids.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), order))).withColumn("rank", draw(F.concat_ws("-", "read_id", "k"), f"{seed}:pick", F.lit(n)))
    got = picks.select("read_id", "rank").distinct().join(lib, "rank").join(refs.select("sid", "name", "seq"), "sid")
    w = Window.partitionBy("read_id", "sid").orderBy("b", "e")
    free = got.withColumn("last", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("last is null or last <= b")
    part = F.struct("sid", "b", F.concat_ws("-", "name", "b", "e", F.lit("0"), F.lit("0")).alias("t"), F.expr("substring(seq, b + 1, e - b)").alias("s"))
    x = F.array_sort(F.collect_list(part))
    reads_ = free.groupBy("read_id").agg(x.alias("x"))
    head = F.concat(F.lit("sim"), "read_id", F.lit(" p0_"), F.col("x")[0]["sid"], F.lit("_"), "read_id", F.lit(" "), F.array_join(F.transform("x", lambda p: p["t"]), ";"))
    return reads_.select("read_id", head.alias("header"), F.array_join(F.transform("x", lambda p: p["s"]), "").alias("seq"))
