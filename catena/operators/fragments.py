"""Fragments of reads: ranks, primaries, contacts, statistics, evaluation, simulation libraries.

A fragment table has read_id, sid, strand, sb, se, mapq and score. Pairs of a
read's fragments are counted by sums over groups where a count will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAPQ = 5


def numbered(frags: DataFrame, order: list[str]) -> DataFrame:
    """frags with frag_id: the rank in the read from 0, by order."""
    return frags.withColumn("frag_id", F.row_number().over(Window.partitionBy("read_id").orderBy(*order)) - 1)


def sam_flags(frags: DataFrame, order: list[str]) -> DataFrame:
    """frags with flag: 16 if reversed, 2048 unless it is the read's first one with the largest score above 0."""
    best = F.row_number().over(Window.partitionBy("read_id").orderBy(F.desc("score"), *order)) == 1
    primary = best & (F.col("score") > 0)
    return frags.withColumn("flag", F.col("strand").cast("int") * 16 + F.when(primary, 0).otherwise(2048))


def contact_pairs(frags: DataFrame, order: list[str], mapq: int = MAPQ, strict: bool = False) -> DataFrame:
    """Pairs of a read's fragments on one contig, the later one of mapq at least, with strict both: (read_id, sid, a, b)."""
    f = numbered(frags, order).select("read_id", "sid", "frag_id", "mapq")
    left = f.where(F.col("mapq") >= mapq) if strict else f
    right = f.where(F.col("mapq") >= mapq).select("read_id", "sid", F.col("frag_id").alias("b"))
    return left.select("read_id", "sid", F.col("frag_id").alias("a")).join(right, ["read_id", "sid"]).where("a < b")


def contact_counts(frags: DataFrame, order: list[str], mapq: int = MAPQ) -> DataFrame:
    """(reads, frags, contacts, strict_contacts) without making pairs.

    A fragment of mapq at least has as many contacts as there are earlier ones
    of its read on its contig; strict ones come to n (n - 1) / 2.
    """
    before = F.row_number().over(Window.partitionBy("read_id", "sid").orderBy("frag_id")) - 1
    f = numbered(frags, order).withColumn("before", before)
    good = F.col("mapq") >= mapq
    by = f.groupBy("read_id", "sid").agg(F.sum(good.cast("long")).alias("n"), F.sum(F.when(good, F.col("before")).otherwise(0)).alias("c"))
    by_read = by.groupBy("read_id").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum(F.expr("n * (n - 1) div 2")).alias("s"))
    return by_read.agg(F.count(F.lit(1)).alias("reads"), F.sum("n").alias("frags"), F.sum("c").alias("contacts"), F.sum("s").alias("strict_contacts"))


def end_support(frags: DataFrame, left: Column, right: Column, mapq: int = MAPQ) -> DataFrame:
    """(frags, supported, fraction): ends that lie on a site, of all ends of fragments of mapq at least."""
    f = frags.where(F.col("mapq") >= mapq)
    n, s = F.count(F.lit(1)), F.coalesce(F.sum(left.cast("long") + right.cast("long")), F.lit(0))
    return f.agg(n.alias("frags"), s.alias("supported"), F.when(n > 0, s / (2 * n)).alias("fraction"))


def histogram(frags: DataFrame, length: Column, score: Column, width: int = 100, bins: int = 20, mapq: int = MAPQ) -> DataFrame:
    """(centre, n, mean_score) for every bin of width below bins * width; an empty bin has a null mean."""
    got = frags.where((F.col("mapq") >= mapq) & (length < width * bins)).groupBy(F.floor(length / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"))
    every = frags.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(got, "bin", "left").select((F.col("bin") * width + width // 2).alias("centre"), F.coalesce("n", F.lit(0)).alias("n"), "mean_score")


def prefix_by_sum(records: DataFrame, order: list[str], size: str, most: int, rows: int | None = None) -> DataFrame:
    """Records up to the one with which the sum of sizes reaches most, and rows at most.

    Sums are taken by range partition first and then within each, so that no
    task sorts all records.
    """
    spark = records.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = records.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    sums = dealt.groupBy("_part").agg(F.sum(size).alias("_s"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    base = sums.select("_part", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_sb"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_nb"))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(base, "_part").withColumn("_before", F.col("_sb") + F.coalesce(F.sum(size).over(own), F.lit(0)))
    out = out.withColumn("_row", F.col("_nb") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    keep = F.col("_before") < most
    return out.where(keep & (F.col("_row") <= rows) if rows is not None else keep).select(*records.columns)


def length_stats(lengths: DataFrame, col: str = "len") -> DataFrame:
    """One row: n, total, min, max, mean (whole), median, n25, n50, n75: the value at place int(n * q) from below.

    Places are found on the counts of distinct lengths.
    """
    by = lengths.groupBy(F.col(col).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = by.withColumn("upto", F.sum("c").over(Window.orderBy("v")))
    total = by.agg(F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("total"), F.min("v").alias("min"), F.max("v").alias("max"))
    at = lambda q, name: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("v"))).alias(name)
    found = upto.crossJoin(F.broadcast(total)).groupBy("n", "total", "min", "max")  # the one row of totals
    return found.agg(at(0.5, "median"), at(0.25, "n25"), at(0.5, "n50"), at(0.75, "n75")).withColumn("mean", F.expr("total div n"))


def evaluate(called: DataFrame, truth: DataFrame, order: list[str], mapq: int = MAPQ, share: float = 0.8, slack: int = 4) -> DataFrame:
    """Called fragments against true ones (read_id, sid, ord, sb, se), one row.

    A call is right if the first true one of its read and contig that it
    overlaps by share of both lengths exists; its ends count if within slack.
    Contact figures are pairs of right calls of a read over called and over
    true pairs.
    """
    calls = numbered(called.where(F.col("mapq") >= mapq), order)
    t = truth.select("read_id", "sid", F.col("ord").alias("t_ord"), F.col("sb").alias("tb"), F.col("se").alias("te"))
    o = F.least("se", "te") - F.greatest("sb", "tb")
    hit = calls.join(t, ["read_id", "sid"]).where((o >= share * (F.col("se") - F.col("sb"))) & (o >= share * (F.col("te") - F.col("tb"))) & (o > 0))
    ends = (F.abs(F.col("sb") - F.col("tb")) <= slack).cast("long") + (F.abs(F.col("se") - F.col("te")) <= slack).cast("long")
    first = hit.groupBy("read_id", "frag_id").agg(F.min_by(ends, "t_ord").alias("ends"))
    per = calls.select("read_id", "frag_id").join(first, ["read_id", "frag_id"], "left").groupBy("read_id").agg(F.count(F.lit(1)).alias("n"), F.count("ends").alias("k"), F.sum("ends").alias("e"))
    pairs = lambda c: F.coalesce(F.sum(F.expr(f"{c} * ({c} - 1) div 2")), F.lit(0))
    calls_row = per.agg(F.sum("n").alias("n_called"), F.sum("k").alias("n_right"), F.sum("e").alias("ends"), pairs("n").alias("called_pairs"), pairs("k").alias("right_pairs"))
    truth_row = truth.groupBy("read_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n_true"), pairs("n").alias("true_pairs"))
    both = calls_row.crossJoin(truth_row)  # one row each
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return both.select(
        "n_true", "n_called", "n_right", ratio("n_right", "n_called").alias("precision"), ratio("n_right", "n_true").alias("recall"),
        F.when(F.col("n_right") > 0, F.col("ends") / (2 * F.col("n_right"))).alias("boundary_precision"),
        "true_pairs", "called_pairs", "right_pairs", ratio("right_pairs", "called_pairs").alias("contact_precision"), ratio("right_pairs", "true_pairs").alias("contact_recall"),
    )


def parents(hits: DataFrame, share: float = 0.8) -> DataFrame:
    """hits (read_id, hit, b, e, rank) with parent: the earlier rank that overlaps most on the read, the closest in ties, if by share of the hit's length."""
    other = hits.select("read_id", F.col("rank").alias("p"), F.col("b").alias("pb"), F.col("e").alias("pe"))
    o = F.least("e", "pe") - F.greatest("b", "pb")
    pairs = hits.join(other, "read_id").where((F.col("p") < F.col("rank")) & (o > 0) & (o >= share * (F.col("e") - F.col("b"))))
    best = pairs.groupBy("read_id", "rank").agg(F.max_by("p", F.struct(o, "p")).alias("parent"))
    return hits.join(best, ["read_id", "rank"], "left")


def chunks(fragments: DataFrame, order: list[str], key: str = "sid", n: int = 10) -> DataFrame:
    """fragments with chunk: n chunks of ceil(count / n) in each contig."""
    w = Window.partitionBy(key)
    rank = F.row_number().over(w.orderBy(*order)) - 1
    return fragments.withColumn("chunk", F.floor(rank / F.ceil(F.count(F.lit(1)).over(w) / F.lit(float(n)))))


def cover_path(spans: DataFrame, size: int, least: int = 50) -> DataFrame:
    """The cheapest path of spans (read_id, node, b, e, score) over each read: gaps cost, scores pay.

    A gap of g bases costs 4 + 2 g; the next span begins and ends at least
    least bases later. Nodes are in the order of their number, so one pass in
    that order is enough; the pass is a fold over a read's spans, in the JVM.
    Returns (read_id, cost, path): the node numbers.
    """
    ordered = spans.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("b", "e", "node", "score"))).alias("spans"))
    gap = lambda g: F.when(g == 0, F.lit(0).cast("long")).otherwise((4 + 2 * g).cast("long"))
    kind = "array<struct<cost:bigint,b:bigint,e:bigint,path:array<bigint>>>"

    def step(done: Column, s: Column) -> Column:
        b, e = s["b"].cast("long"), s["e"].cast("long")
        start = F.struct(gap(b).alias("cost"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("e"), F.array().cast("array<bigint>").alias("path"))
        fit = F.filter(done, lambda d: (b - d["b"] >= least) & (e - d["e"] >= least))
        ways = F.concat(F.array(start), F.transform(fit, lambda d: F.struct((d["cost"] + gap(F.abs(b - d["e"]))).alias("cost"), d["b"].alias("b"), d["e"].alias("e"), d["path"].alias("path"))))
        best = F.array_min(F.transform(ways, lambda d: F.struct(d["cost"].alias("cost"), d["path"].alias("path"))))
        new = F.struct((best["cost"] - s["score"].cast("long")).alias("cost"), b.alias("b"), e.alias("e"), F.concat(best["path"], F.array(s["node"].cast("long"))).alias("path"))
        return F.concat(done, F.array(new))

    ends = F.aggregate("spans", F.array().cast(kind), step, lambda done: F.array_min(F.transform(done, lambda d: F.struct((d["cost"] + gap(size - d["e"])).alias("cost"), d["path"].alias("path")))))
    return ordered.select("read_id", ends.alias("x")).select("read_id", F.col("x.cost").alias("cost"), F.col("x.path").alias("path"))


def order_histogram(frags: DataFrame) -> DataFrame:
    """(frags, reads): reads by how many fragments they have."""
    return frags.groupBy("read_id").agg(F.count(F.lit(1)).alias("frags")).groupBy("frags").agg(F.count(F.lit(1)).alias("reads"))


def strand_histogram(frags: DataFrame) -> DataFrame:
    """(strand, frags)."""
    return frags.groupBy("strand").agg(F.count(F.lit(1)).alias("frags"))


def read_subset(frags: DataFrame, n: int, short: int = 200, seed: int = 0) -> DataFrame:
    """(read_id, has_short): n reads, those with a fragment under short bases (b, e) first, drawn by a hash of the id and seed."""
    per = frags.groupBy("read_id").agg(F.max((F.col("e") - F.col("b") < short).cast("int")).alias("has_short"))
    draw = F.md5(F.concat_ws(":", F.lit(seed), "read_id"))
    return per.orderBy(F.desc("has_short"), draw, "read_id").limit(n).select("read_id", (F.col("has_short") == 1).alias("has_short"))


def site_support(frags: DataFrame, sites: DataFrame, mapq: int = MAPQ) -> DataFrame:
    """(frags, supported, fraction): ends of frags (sid, sb, se, mapq) that are in sites (sid, pos), by equi-join on both."""
    f = frags.where(F.col("mapq") >= mapq)
    ends = f.select("sid", F.explode(F.array("sb", "se")).alias("pos")).groupBy("sid", "pos").agg(F.count(F.lit(1)).alias("n"))
    hit = ends.join(sites.select("sid", "pos", F.lit(1).alias("on")).distinct(), ["sid", "pos"], "left")
    total, on = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("on").isNotNull(), F.col("n")).otherwise(0)), F.lit(0))
    return hit.agg((total / 2).cast("long").alias("frags"), on.alias("supported"), F.when(total > 0, on / total).alias("fraction"))


def union_numbered(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """The rows of some tables, one after another, with read_id from 0 in order, over all of them.

    Rows are dealt in ranges of (table, order) and counted by range first, so
    that no task numbers all.
    """
    every = None
    for k, part in enumerate(parts):
        part = part.withColumn("file", F.lit(k))
        every = part if every is None else every.unionByName(part)
    if every is None:
        raise ValueError("no tables")
    n = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = every.repartitionByRange(n, "file", *order).withColumn("_part", F.spark_partition_id())
    sums = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    base = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("file", *order)) - 1
    return dealt.withColumn("_r", rank).join(base, "_part").withColumn("read_id", F.col("_b") + F.col("_r")).drop("_part", "_r", "_b")


def of_reads(records: DataFrame, reads: DataFrame, name: str = "qname") -> DataFrame:
    """SAM records with read_id and length of the read that has their name; records of unknown reads go."""
    own = reads.select(F.col("name").alias(name), "read_id", F.length("seq").alias("read_len"))
    return records.join(own, name)
