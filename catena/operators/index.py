"""Contigs, the canonical k-mer index with its repeat cutoff, and seeds by equi-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catena.functions import dna

K, STEP, FRACTION, FLOOR = 15, 3, 0.0003, 100
#: Seeds of one read that may share a position of a contig.
SEEDS_AT_ONE = 10


def contigs(table: DataFrame, sid: str, name: str, seq: Column) -> DataFrame:
    """(sid, name, len, seq) of the rows whose sequence isn't empty."""
    out = table.select(F.col(sid).alias("sid"), F.col(name).cast("string").alias("name"), F.upper(seq).alias("seq"))
    return out.select("sid", "name", F.length("seq").alias("len"), "seq").where("len > 0")


#: Bases of a block in which a contig's k-mers are cut, a multiple of most steps; a worker codes about as many at a time.
BLOCK = 3 * 5 * 7 << 12
_CODE = np.full(256, 4, np.uint8)
_CODE[list(b"ACGT")] = [0, 1, 2, 3]


def _coded(data: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of data: the k-mer from there and its reverse complement, two bits a base, and whether it is one and no palindrome."""
    codes = _CODE[np.frombuffer(data, np.uint8)]
    n = len(codes) - k + 1
    forward, backward = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j in range(k):
        part = codes[j : j + n].astype(np.int64) & 3
        forward |= part << 2 * (k - 1 - j)
        backward |= (3 - part) << 2 * j
    bad = np.concatenate(([0], np.cumsum(codes > 3)))
    return forward, backward, (bad[k:] == bad[:n]) & (forward != backward)


def kmers(table: DataFrame, key: str, k: int = K, step: int = 1, seq: str = "seq") -> DataFrame:
    """(key, pos, kmer, rev): canonical k-mers at positions divisible by step, without palindromes and ambiguous bases.

    A k-mer is a long of two bits a base, A C G T, so that order is that of the
    letters. Sequences are dealt in blocks that overlap by k - 1 bases, so that a
    chromosome is many rows; null and short ones have no k-mers.
    """
    if not 0 < k < 32:
        raise ValueError("a k-mer has 1 to 31 bases")
    size = max(1, BLOCK // step) * step

    def cuts(raw: Column) -> Column:
        begins = F.when(F.length(raw) >= k, F.sequence(F.lit(0), F.length(raw) - k, F.lit(size)))
        return F.transform(begins, lambda p: F.struct(p.alias("begin"), F.substring(raw, p + 1, F.lit(size + k - 1)).alias("part")))

    blocks = table.select(F.col(key).cast("long").alias(key), F.explode(dna.bound(F.col(seq).cast("binary"), cuts)).alias("x")).select(key, "x.begin", "x.part")
    names = [key, "pos", "kmer", "rev"]

    def made(keys: list, begins: list, parts: list) -> pa.RecordBatch:
        forward, backward, ok = _coded(b"-".join(parts), k)
        sizes = np.array([len(x) + 1 for x in parts])
        own = np.repeat(np.arange(len(parts)), sizes)[: len(ok)]
        place = np.arange(len(ok)) - (np.cumsum(sizes) - sizes)[own]
        at = np.flatnonzero(ok & (place % step == 0))
        forward, backward, own = forward[at], backward[at], own[at]
        pos = place[at] + np.array(begins)[own]
        return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)[own]), pa.array(pos.astype(np.int32)), pa.array(np.minimum(forward, backward)), pa.array(forward > backward)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: tuple[list, list, list] = ([], [], [])
            bases = 0
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for list_, value in zip(held, row):
                    list_.append(value)
                bases += len(row[2])
                if bases >= size:
                    yield made(*held)
                    held, bases = ([], [], []), 0
            if bases:
                yield made(*held)

    return blocks.where(F.col(key).isNotNull()).mapInArrow(run, f"`{key}` long, pos int, kmer long, rev boolean")


def bucket(kmer: Column, k: int = K) -> Column:
    """The first two bases of a k-mer."""
    letter = lambda shift: F.element_at(F.array(*map(F.lit, "ACGT")), (F.shiftright(kmer, shift).bitwiseAND(3) + 1).cast("int"))
    return F.concat(letter(2 * k - 2), letter(2 * k - 4))


def kmer_counts(index: DataFrame) -> DataFrame:
    """(kmer, count); read more than once, so Spark keeps its exchange where it can."""
    return index.groupBy("kmer").count()


def bucket_cutoffs(index: DataFrame, fraction: float = FRACTION, floor: int = FLOOR, k: int = K) -> DataFrame:
    """(bucket, distinct_kmers, cutoff): by first two bases, the count at floor(distinct * fraction) from the top, floor at least."""
    # Ranks over distinct counts, of which there are few, not over k-mers: the count at a rank is where the running number of k-mers passes it.
    by = kmer_counts(index).groupBy(F.shiftright("kmer", 2 * k - 4).alias("top"), "count").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("top")
    passed = by.withColumn("upto", F.sum("n").over(own.orderBy(F.desc("count")))).withColumn("distinct_kmers", F.sum("n").over(own))
    at = passed.where(F.col("upto") > F.floor(F.col("distinct_kmers") * fraction)).groupBy("top", "distinct_kmers").agg(F.max("count").alias("most"))
    return at.select(bucket(F.col("top"), 2).alias("bucket"), "distinct_kmers", F.greatest(F.lit(floor).cast("long"), "most").alias("cutoff"))


def repeats(index: DataFrame, fraction: float = FRACTION, floor: int = FLOOR, k: int = K) -> DataFrame:
    """(kmer, count) of the k-mers that are more frequent than their bucket's cutoff."""
    counts = kmer_counts(index).where(F.col("count") > floor).withColumn("bucket", bucket(F.col("kmer"), k))
    return counts.join(bucket_cutoffs(index, fraction, floor, k), "bucket").where(F.col("count") > F.col("cutoff")).select("kmer", "count")


def without_repeats(index: DataFrame, fraction: float = FRACTION, floor: int = FLOOR, k: int = K) -> DataFrame:
    """index without the k-mers that are more frequent than their bucket's cutoff."""
    return index.join(repeats(index, fraction, floor, k).select("kmer"), "kmer", "left_anti")


def build_index(refs: DataFrame, k: int = K, step: int = STEP, fraction: float = FRACTION, floor: int = FLOOR) -> DataFrame:
    """(kmer, sid, pos, rev) of the contigs, repeats filtered."""
    return without_repeats(kmers(refs, "sid", k, step), fraction, floor, k).select("kmer", "sid", "pos", "rev")


def seeds(reads: DataFrame, index: DataFrame, k: int = K, most: int = SEEDS_AT_ONE) -> DataFrame:
    """(read_id, sid, strand, soff, qoff): k-mers that a read shares with the index; offsets are of last bases.

    On the reverse strand qoff counts on the read's reverse complement. Seeds
    of which a read has over most at one place of a contig are left out.
    """
    own = kmers(reads.select("read_id", "seq"), "read_id", k).withColumnRenamed("pos", "qpos").withColumnRenamed("rev", "qrev")
    hit = own.join(index, "kmer").join(reads.select("read_id", F.length("seq").alias("len")), "read_id")
    strand = (F.col("qrev") != F.col("rev")).cast("int")
    last = F.col("qpos") + k - 1
    hit = hit.select("read_id", "sid", strand.alias("strand"), (F.col("pos") + k - 1).alias("soff"), F.when(strand == 0, last).otherwise(F.col("len") - 1 - F.col("qpos")).alias("qoff"))
    place = Window.partitionBy("read_id", "sid", "strand", "soff")
    return hit.withColumn("n", F.count(F.lit(1)).over(place)).where(F.col("n") <= most).drop("n")
