"""SimHash near-dedup with pigeonring filtering.

Fingerprints are cut into 2 d + 1 segments on a ring, d the distance allowed.
By the pigeonring principle two fingerprints within d differ, from some start
on, by at most floor(l d / m) bits in the first l of m segments, for every l.
That is zero for two segments, which are the key of an equi-join; longer
chains are checked next, and only then the whole distance.

A key held by many distinct fingerprints would emit too many pairs. Those
fingerprints go another exact way: two are within two bits iff some point is
within one bit of both, so each is sent to its 65 such points, and a point's
fingerprints, 65 at most, are linked with the smallest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catena.llm.common import KeyBitmap, Scratch, lean_driver, lean_worker, saved, skew_join
from catena.llm.components import connected_components

SEED = 42
BITS = 64
#: Distinct fingerprints under one key that are still compared in pairs.
SMALL_BUCKET = 32
#: Texts that a worker holds the shingles of at a time.
ROWS = 256


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; fewer words make one shingle, none make no hash."""
    split = text.lower().split()  # of bytes: A-Z only, and exactly the ASCII white space
    if not split:
        return np.empty(0, np.uint64)
    joined = b" ".join(split)
    if len(split) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1)
    begins = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(begins[: len(split) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit by bit, whether over half the hashes have it; no hashes give zero."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[k : k + (1 << 16)]).astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each text as a signed long; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(shingle_hashes(t.as_py() or b"", words)) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _ring(distance: int) -> list[list[int]]:
    """For each start, the masks of chains of 2, 3, ... segments, as signed longs."""
    m = 2 * distance + 1
    cuts = [BITS * k // m for k in range(m + 1)]
    seg = [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(m)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for start in range(m):
        mask, masks = 0, []
        for length in range(1, m + 1):
            mask |= seg[(start + length - 1) % m]
            if length >= 2:
                masks.append(signed(mask))
        out.append(masks)
    return out


def chain_within(diff: Column, budget: int, segments: int, chain: int) -> Column:
    """The pigeonring test: from some segment on, each of the first chain lengths l has at most l budget / segments of diff's bits.

    Two fingerprints within budget always pass it, whatever the chain.
    """
    cuts = [BITS * k // segments for k in range(segments + 1)]
    bits = [F.bit_count(F.shiftrightunsigned(diff, cuts[k]).bitwiseAND((1 << cuts[k + 1] - cuts[k]) - 1)) for k in range(segments)]
    starts = []
    for k in range(segments):
        total, ok = F.lit(0), F.lit(True)
        for l in range(1, chain + 1):
            total = total + bits[(k + l - 1) % segments]
            ok &= total <= l * budget // segments
        starts.append(ok)
    return reduce(Column.__or__, starts)


def near_links(points: DataFrame, distance: int = 2, small: int = SMALL_BUCKET, keep: Callable[[DataFrame], DataFrame] = saved) -> DataFrame:
    """Links (a, b) between rows of points (rep long, fp long; fp distinct) that connect all within distance bits.

    Pairs in small buckets come out one by one, those of hot buckets as stars
    that connect the same rows. keep writes what is read more than once.
    """
    if distance != 2:
        raise ValueError("the way of hot buckets is for two bits")
    ring = _ring(distance)
    m = len(ring)
    keyed = points.withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(m)])))
    pick = lambda at: F.element_at(F.array(*[F.lit(masks[at]).cast("long") for masks in ring]), F.col("start") + 1)
    keyed = keyed.withColumn("key", F.xxhash64("start", F.col("fp").bitwiseAND(pick(0))))
    counts = keyed.groupBy("key").count().where("count > 1").withColumnRenamed("count", "n")
    dense = keep(skew_join(keyed, counts, "key"))

    left = dense.where(F.col("n") <= small)
    right = left.select("key", F.col("rep").alias("rep2"), F.col("fp").alias("fp2"), F.col("start").alias("start2"))
    diff = F.col("fp").bitwiseXOR(F.col("fp2"))
    ok = (F.col("rep") < F.col("rep2")) & (F.col("start") == F.col("start2"))
    for k in range(m - 1):
        ok &= F.bit_count(diff.bitwiseAND(pick(k))) <= (k + 2) * distance // m
    pairs = left.join(right, "key").where(ok).select(F.col("rep").alias("a"), F.col("rep2").alias("b"))

    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(BITS)])
    hot = dense.where(F.col("n") > small).select("rep", "fp").distinct()
    near = hot.select("rep", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    balls = near.groupBy("point").agg(F.array_sort(F.collect_list("rep")).alias("reps")).where("size(reps) > 1")
    stars = balls.select(F.col("reps")[0].alias("a"), F.explode(F.slice("reps", 2, BITS)).alias("b"))
    return pairs.unionByName(stars).distinct()


def simhash_components(docs: DataFrame, words: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, component_id.

    Texts are lower-cased in A-Z and split at ASCII white space; shingles are
    of words words, repeats included. A text with fewer words is one shingle;
    an empty, blank or null text has fingerprint zero and is linked like any
    other. component_id is the smallest doc_id reachable over fingerprints
    within distance bits. Repeated rows come out as often as they came in;
    rows without an id have no part in components and get a null one. An
    empty table gives an empty one. Other columns are not read.
    """
    fps = saved(fingerprints(docs, words, id_col, text_col))
    with Scratch(docs.sparkSession) as own:
        points = own.saved(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
        found = connected_components(near_links(points, distance, keep=own.saved), keep=own.saved)
        of = saved(points.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id")))
    joined = skew_join(fps, of, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


#: Near copies: words of a shingle, least Jaccard similarity of the shingle sets.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8
#: Bits that fingerprints of near copies may differ in, segments and chain of the pigeonring test before that, and the
#: shingles that the smaller set must have for it. At a similarity of 0.8 a bit of the fingerprints differs with a chance
#: of at most acos(0.8 / 0.9) / pi = 0.15, so the test loses one pair in 10^8 at the threshold and fewer above it.
NEAR_BITS, NEAR_SEGMENTS, NEAR_CHAIN, NEAR_LEAST = 28, 8, 4, 64
#: Words of the wide fingerprints, and bits of theirs that near copies may differ in, by the same chance: the test loses
#: fewer than one pair in 10^8 at the threshold and rules out most pairs with a similarity under a half.
WIDE, WIDE_BITS = 8, 128
#: Bits that differ, at most, between those of a bucket that are compared first; this decides the order of work, not the result.
NEAR_FIRST = 8
#: Documents that the frequent shingles are taken from, how many of them must have one, and how many are kept; they decide the order of work, not the result.
SAMPLE, FREQUENT, MOST_FREQUENT = 10_000, 3, 50_000
#: Members of a bucket that meet as many others in one task, about.
TILE = 2048
#: Links whose components one task finds, 4 MiB of them at most; of more, rounds over all tasks do.
LINKS_AT_ONCE = 1 << 18


def wide_fingerprint(hashes: np.ndarray, words: int = WIDE) -> np.ndarray:
    """words further fingerprints of 64 bits, each of the hashes mixed anew, as signed longs."""
    ones = np.zeros((words, BITS), np.int64)
    for k in range(0, len(hashes), 1 << 13):
        part = hashes[k : k + (1 << 13)].astype(np.uint64)
        for j in range(words):
            mixed = part + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(31)
            ones[j] += np.unpackbits(mixed.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), axis=1).view(">i8").astype(np.int64).reshape(words)


def shingle_set(text: bytes, words: int = NEAR_WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(shingle_hashes(text, words))


def prefix(own: np.ndarray, frequent: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Prefix of a shingle set, as signed longs.

    Sets are ordered by how often frequent (sorted hashes, counts) has a
    shingle, then by hash. Two sets with a similarity of NEAR_SIMILARITY share
    at least that part of the larger one, so their prefixes, one longer than
    what each may lack, have a shingle in common.
    """
    if not len(own):
        return own.view(np.int64)
    order = own
    if frequent is not None and len(frequent[0]):
        at = np.minimum(np.searchsorted(frequent[0], own), len(frequent[0]) - 1)
        order = own[np.lexsort((own, np.where(frequent[0][at] == own, frequent[1][at], 0)))]
    return order[: prefix_length(len(own))].view(np.int64)


def prefix_length(n: int) -> int:
    return n - math.ceil(n * NEAR_SIMILARITY - 1e-9) + 1


def alike(a: Column, b: Column) -> Column:
    """Whether two sets, as arrays of longs, have a Jaccard similarity of NEAR_SIMILARITY: four ninths of both sizes in common."""
    return F.size(F.array_intersect(a, b)) * 9 >= (F.size(a) + F.size(b)) * 4


def wide_apart(a: Column, b: Column) -> Column:
    """Bits that differ between two wide fingerprints."""
    return reduce(Column.__add__, [F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(WIDE)])


def index_length(n: Column) -> Column:
    """Shingles of its prefix that a set of n needs to be found by sets that are no smaller: what it shares with those is 8/9 of it at least."""
    return n - F.floor((n * 8 + 8) / 9).cast("int") + 1


def unconnected_pairs(members: DataFrame, found: DataFrame, tile: int = TILE, keep: Callable[[DataFrame], DataFrame] = saved, fps: DataFrame | None = None, bits: int = BITS, least: int = 0) -> DataFrame:
    """(a, b, na, nb, diff), a < b, sizes and the bits that differ in fingerprints: every two documents of one bucket that found (node, component) does not connect and that may be alike.

    members has bucket, doc_id, size, the number of shingles, and pos, the
    bucket's place in the prefix (1 if there is no such column). Two don't meet
    whose sizes differ too much for NEAR_SIMILARITY, if the bucket is not in the
    smaller one's index_length, or if it is too far behind in one of them to be
    the first that they share. In a bucket, those outside its largest component
    meet all, in salted tiles. A pair comes once for each bucket where it meets.
    With fps (doc_id, fp) also those don't whose fingerprints differ in over bits
    bits, if the smaller set has least shingles at least.
    """
    if "pos" not in members.columns:
        members = members.withColumn("pos", F.lit(1))
    labelled = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    labelled = labelled.join(fps, "doc_id") if fps is not None else labelled.withColumn("fp", F.lit(0).cast("long"))
    labelled = keep(labelled.distinct())
    parts = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"))
    sizes = parts.groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("most"), F.sum("k").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    tiles = lambda n: F.ceil(n / float(tile)).cast("int")
    sizes = sizes.select("bucket", F.col("most.component").alias("main"), tiles(F.col("n") - F.col("most.k")).alias("rows"), tiles(F.col("n")).alias("columns"))
    dealt = keep(skew_join(labelled, sizes, "bucket"))
    place = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.where("component <> main").withColumn("row", place("rows")).withColumn("column", every("columns"))
    left = left.select("bucket", "row", "column", F.col("doc_id").alias("x"), F.col("size").alias("nx"), F.col("pos").alias("px"), F.col("fp").alias("fx"), F.col("component").alias("cx"))
    right = dealt.withColumn("column", place("columns")).withColumn("row", every("rows"))
    right = right.select("bucket", "row", "column", "main", F.col("doc_id").alias("y"), F.col("size").alias("ny"), F.col("pos").alias("py"), F.col("fp").alias("fy"), F.col("component").alias("cy"))
    small, large = F.least("nx", "ny"), F.greatest("nx", "ny")
    first = (F.col("nx") < F.col("ny")) | (F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y"))
    listed = F.when(first, F.col("px") <= index_length(F.col("nx"))).otherwise(F.col("py") <= index_length(F.col("ny")))
    most = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) + 1
    apart = F.bit_count(F.col("fx").bitwiseXOR(F.col("fy")))
    may = (small * 5 >= large * 4) & ((apart <= bits) | (small < least)) & listed & (most * 9 >= (F.col("nx") + F.col("ny")) * 4)
    met = left.join(right, ["bucket", "row", "column"]).where((F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("main")) | (F.col("x") < F.col("y"))) & may)
    low = F.col("x") < F.col("y")
    pick = lambda c, d, n: F.when(low, F.col(c)).otherwise(F.col(d)).alias(n)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), pick("nx", "ny", "na"), pick("ny", "nx", "nb"), F.col("fx").bitwiseXOR(F.col("fy")).alias("diff"))


def frequent_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the shingles that a bounded sample of rows (doc_id, text) has most often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(1).cast(pa.binary()):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t.as_py() or b"", NEAR_WORDS)).view(np.int64))], ["hash"])

    draw = F.pmod(F.xxhash64("doc_id", F.lit("frequent")), F.lit(1 << 30)) / float(1 << 30)
    some = rows.where(draw < SAMPLE / max(1, rows.count())).mapInArrow(run, "hash long")
    top = some.groupBy("hash").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "hash").limit(MOST_FREQUENT).toPandas()
    top = top.assign(hash=top["hash"].to_numpy(np.int64).view(np.uint64)).sort_values("hash")
    return top["hash"].to_numpy(np.uint64), top["count"].to_numpy(np.int64)


def hot_pairs(hot: DataFrame, marks: DataFrame) -> DataFrame:
    """(a, b, na, nb, diff), a < b, as of unconnected_pairs: each member of hot (bucket, doc_id, n) with some centres of its largest bucket.

    marks (doc_id, fp, size) has each document once. What a centre has of it comes with it, so that pairs need not be joined with marks again.

    One is the member nearest to the majority of the bucket's fingerprints, the
    original of copies that resemble it more than one another; three are any.
    """
    largest = hot.groupBy("doc_id").agg(F.max(F.struct("n", "bucket")).alias("most")).select("doc_id", "most.bucket").join(marks, "doc_id")
    ones = [F.sum(F.shiftright("fp", k).bitwiseAND(1) * 2 - 1).alias(f"s{k}") for k in range(BITS)]
    majority = largest.groupBy("bucket").agg(*ones)
    majority = majority.select("bucket", reduce(Column.bitwiseOR, [F.shiftleft((F.col(f"s{k}") > 0).cast("long"), k) for k in range(BITS)]).alias("mid"))
    away = F.bit_count(F.col("fp").bitwiseXOR(F.col("mid")))
    member = F.struct("doc_id", "fp", "size")
    firsts = [away, *[F.xxhash64("doc_id", F.lit(k)) for k in (1, 2, 3)]]
    centres = skew_join(largest, majority, "bucket").groupBy("bucket").agg(*[F.min(F.struct(x.alias("first"), member.alias("of"))).alias(f"c{k}") for k, x in enumerate(firsts)])
    centres = centres.select("bucket", F.array_distinct(F.array(*[f"c{k}.of" for k in range(4)])).alias("centres"))
    many = skew_join(largest, centres, "bucket").select("doc_id", "fp", "size", F.explode("centres").alias("c")).where("doc_id <> c.doc_id")
    low = F.col("doc_id") < F.col("c.doc_id")
    na, nb = F.when(low, F.col("size")).otherwise(F.col("c.size")), F.when(low, F.col("c.size")).otherwise(F.col("size"))
    return many.select(F.least("doc_id", "c.doc_id").alias("a"), F.greatest("doc_id", "c.doc_id").alias("b"), na.alias("na"), nb.alias("nb"), F.col("fp").bitwiseXOR(F.col("c.fp")).alias("diff"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, component) of documents with near copies: shingles of five words, Jaccard similarity of 0.8 or more.

    By prefix filtering every such pair is found: sets in one order, frequent
    shingles last, share a shingle of their prefixes. Where a shingle has over
    SMALL_BUCKET texts, each is compared with some centres of its largest bucket
    first; then every two texts of a bucket that are not connected yet, unless
    their sizes or the shingle's places in their prefixes rule them out. Pairs go through the pigeonring test on their fingerprints,
    the whole distance and that of wide fingerprints; whole shingle sets decide. Null, empty and blank texts
    are near nothing; texts of fewer than five words near those of the same
    words. Rows without an id have no part; those that share an id count as the
    first of them.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    frequent = frequent_shingles(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean_worker():
            for batch in batches:
                for k in range(0, batch.num_rows, ROWS):
                    part = batch.slice(k, ROWS)
                    sets = [shingle_set(t.as_py() or b"") for t in part.column(1).cast(pa.binary())]
                    sizes, fps = pa.array(list(map(len, sets)), pa.int32()), pa.array(list(map(fingerprint, sets)), pa.int64())
                    wide, prefixes = ([f(x) for x in sets] for f in (wide_fingerprint, lambda x: prefix(x, frequent)))
                    longs = pa.list_(pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0), sizes, fps, pa.array(wide, longs), pa.array(prefixes, longs)], ["doc_id", "size", "fp", "wide", "prefix"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean_worker():
            for batch in batches:
                for k in range(0, batch.num_rows, ROWS):
                    part = batch.slice(k, ROWS)
                    sets = [shingle_set(t.as_py() or b"").view(np.int64) for t in part.column(1).cast(pa.binary())]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    with Scratch(spark) as own:
        sketches = own.saved(rows.mapInArrow(run, "doc_id long, size int, fp long, wide array<long>, prefix array<long>"))
        marks = own.saved(sketches.groupBy("doc_id").agg(F.min(F.struct("size", "fp", "wide")).alias("m")).select("doc_id", "m.size", "m.fp", "m.wide"))
        keyed = sketches.select("doc_id", "size", F.posexplode("prefix").alias("pos", "bucket")).withColumn("pos", F.col("pos") + 1)
        listed = F.max(F.col("pos") <= index_length(F.col("size")))
        counts = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), listed.alias("listed")).where("n > 1 and listed").drop("listed")
        members = own.saved(skew_join(keyed, counts, "bucket"))

        def of(table: DataFrame, column: str, end: str, into: str) -> DataFrame:
            return table.select(F.col("doc_id").alias(end), F.col(column).alias(into))

        def picked(table: DataFrame, ids: KeyBitmap, wanted: DataFrame) -> DataFrame:
            return ids.mark(table, "_in").where("_in").drop("_in").join(wanted, "doc_id", "left_semi")

        def near(pairs: DataFrame) -> DataFrame:
            with Scratch(spark) as part:
                close = chain_within(F.col("diff"), NEAR_BITS, NEAR_SEGMENTS, NEAR_CHAIN) & (F.bit_count("diff") <= NEAR_BITS)
                small = F.least("na", "nb") < NEAR_LEAST
                # Written first: pushed into the join, the test would be too much for one compiled method.
                links = part.saved(pairs.select("a", "b", "na", "nb", "diff").distinct()).where(small | close)
                links = skew_join(skew_join(links, of(marks, "wide", "a", "wa"), "a"), of(marks, "wide", "b", "wb"), "b")
                links = part.saved(links.where(small | (wide_apart(F.col("wa"), F.col("wb")) <= WIDE_BITS)).select("a", "b"))
                wanted = part.saved(links.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
                # Whole sets take more room than texts, so they are made again for the texts in pairs, not kept for all.
                sets = picked(rows, KeyBitmap(wanted, part), wanted)
                sets = part.saved(sets.mapInArrow(whole, "doc_id long, shingles array<long>").groupBy("doc_id").agg(F.min("shingles").alias("shingles")))
                found = skew_join(links, of(sets, "shingles", "a", "xa"), "a")
                found = skew_join(found, of(sets, "shingles", "b", "xb"), "b")
                return own.saved(found.where(alike(F.col("xa"), F.col("xb"))).select("a", "b"))

        links = near(hot_pairs(members.where(F.col("n") > SMALL_BUCKET), marks.select("doc_id", "fp", "size")))
        # Those nearest by their fingerprints first, as what they connect need not be compared again.
        for bits, least in ((NEAR_FIRST, 0), (NEAR_BITS, NEAR_LEAST)):
            lean_driver(spark)
            with Scratch(spark) as part:
                joined = connected_components(links, keep=part.saved, at_once=LINKS_AT_ONCE)
                rest = unconnected_pairs(members.drop("n"), joined, keep=part.saved, fps=marks.select("doc_id", "fp"), bits=bits, least=least)
                links = own.saved(links.unionByName(near(rest)))
        lean_driver(spark)
        return connected_components(links, at_once=LINKS_AT_ONCE)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of each group the smallest id stays. See near_duplicates for the cases."""
    gone = near_duplicates(docs, id_col, text_col).where("node <> component").select(F.col("node").alias("_gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
