"""Candidates of alignments: local seeds, depth and caps of hits on a read, site candidates, neighbours in a read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catena.functions import dna

#: Seeds of a fragment that may share a place of its subject, bases of a k-mer.
LOCAL_AT_ONE, LOCAL_K = 20, 15
#: Bases of rows, or places of subjects, that a worker looks at together; bases of a block that is cut up in a join.
PLACES, BLOCK = 1 << 18, 1 << 12
#: Bases of a row whose seeds are still found in the row; ids of other rows that may be listed in a plan.
LONG, LISTED = 1 << 20, 10_000
#: Bases that a candidate has on either side at least; hits over one base of a read; depth that is counted.
LEAST, MOST_HITS, MOST_DEPTH = 20, 3, 100


def _numbers(data: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """For each place of data a number of the k bytes from there, the same for the same bytes, and a bound of the numbers."""
    letters = np.cumsum(np.bincount(data, minlength=256) > 0) - 1
    rank, size = letters[data].astype(np.int64), int(letters[-1]) + 1
    n = len(data) - k + 1
    out, bound = rank[:n], size
    for j in range(1, k):
        if bound * size >= 1 << 62:
            out, bound = np.unique(out, return_inverse=True)[1].reshape(-1), n
        out, bound = out * size + rank[j : j + n], bound * size
    return out, bound


def _shared(ids: pa.Array, q: list[bytes], s: list[bytes], k: int, most: int) -> Iterator[pa.RecordBatch]:
    """The seeds of some rows, about PLACES places of subjects at a time."""
    sizes = np.array([len(x) for x in (*q, *s)])
    data = np.frombuffer(b"".join((*q, *s)), np.uint8)
    if len(data) < k:
        return
    numbers, bound = _numbers(data, k)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(numbers)]
    place = np.arange(len(numbers)) - (np.cumsum(sizes) - sizes)[row]
    inside = np.flatnonzero(place <= sizes[row] - k)
    numbers, row, place = numbers[inside], row[inside], place[inside]
    if bound * len(q) >= 1 << 62:
        numbers, bound = np.unique(numbers, return_inverse=True)[1].reshape(-1), len(numbers)
    cut = np.searchsorted(row, len(q))
    row[cut:] -= len(q)
    numbers += row * bound  # of a row's own
    order = np.argsort(numbers[:cut])
    own = numbers[:cut][order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if cut else np.empty(0, np.int64)
    if not len(first):
        return
    kinds, often, at = own[first], np.diff(np.append(first, cut)), place[order]
    for a in range(cut, len(numbers), PLACES):
        part = slice(a, a + PLACES)
        kind = np.minimum(np.searchsorted(kinds, numbers[part]), len(kinds) - 1)
        n = np.where((kinds[kind] == numbers[part]) & (often[kind] <= most), often[kind], 0)
        found = np.arange(n.sum()) + np.repeat(first[kind] - np.cumsum(n) + n, n)
        if len(found):
            offsets = (x.astype(np.int32) for x in (at[found], np.repeat(place[part], n)))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(row[part], n))), *map(pa.array, offsets)], ["id", "qoff", "soff"])


def _seeds_in_rows(pairs: DataFrame, k: int, most: int) -> DataFrame:
    """local_seeds of ids that have one row each: what a row shares is found in the row, so nothing is dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, s, a, bases = [], [], 0, 0
            for b in range(batch.num_rows):
                q.append(batch.column(1)[b].as_py())
                s.append(batch.column(2)[b].as_py())
                bases += len(q[-1]) + len(s[-1])
                if bases >= PLACES or b + 1 == batch.num_rows:
                    yield from _shared(batch.column(0).slice(a, b + 1 - a), q, s, k, most)
                    q, s, a, bases = [], [], b + 1, 0

    rows = pairs.select("id", *[F.col(c).cast("binary").alias(c) for c in "qs"]).where("id is not null and q is not null and s is not null")
    offsets = [T.StructField(c, T.IntegerType()) for c in ("qoff", "soff")]
    return rows.mapInArrow(run, T.StructType([T.StructField("id", pairs.schema["id"].dataType), *offsets]))


def _seeds_by_join(pairs: DataFrame, k: int, most: int) -> DataFrame:
    """local_seeds by joins on (id, k-mer). Places are counted from counts of k-mers, so that no more pairs are made than stay."""

    def cuts(raw: Column, width: int, step: int) -> Column:
        at = F.when(F.length(raw) >= k, F.sequence(F.lit(0), F.length(raw) - k, F.lit(step)))
        return F.transform(at, lambda p: F.struct(p.alias("at"), F.substring(raw, p + 1, F.lit(width)).alias("part")))

    def cut(side: str, name: str) -> DataFrame:
        blocks = pairs.select("id", F.explode(dna.bound(F.col(side).cast("binary"), lambda raw: cuts(raw, BLOCK + k - 1, BLOCK))).alias("b"))
        found = blocks.select("id", "b.at", F.explode(cuts(F.col("b.part"), k, 1)).alias("x"))
        return found.select("id", F.col("x.part").alias("kmer"), (F.col("at") + F.col("x.at")).alias(name))

    own, places = cut("q", "qoff"), cut("s", "soff")
    often = places.join(own.groupBy("id", "kmer").agg(F.count(F.lit(1)).alias("n")), ["id", "kmer"])
    kept = often.groupBy("id", "soff").agg(F.sum("n").alias("n")).where(F.col("n") <= most).select("id", "soff")
    return places.join(kept, ["id", "soff"], "left_semi").join(own, ["id", "kmer"]).select("id", "qoff", "soff")


def local_seeds(pairs: DataFrame, k: int = LOCAL_K, most: int = LOCAL_AT_ONE) -> DataFrame:
    """(id, qoff, soff): the k-mers, as they are read, that q and s of a row (id, q, s) share; places of s with over most go.

    Found within the row. Rows of one id share k-mers with one another too:
    repeated ids, and rows of over LONG bases, are looked for first, in a job
    of their own, and are joined by (id, k-mer). Null ids and sequences have
    no seeds.
    """
    longest = F.greatest(*(F.coalesce(F.length(F.col(c).cast("binary")), F.lit(0)) for c in "qs"))
    by = pairs.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(longest).alias("longest"))
    apart = by.where((F.col("n") > 1) | (F.col("longest") > LONG)).select("id")
    some = apart.limit(LISTED + 1).collect()
    if not some:
        return _seeds_in_rows(pairs, k, most)
    if len(some) <= LISTED:
        apart = F.broadcast(pairs.sparkSession.createDataFrame(some, apart.schema))
    in_rows = _seeds_in_rows(pairs.join(apart, "id", "left_anti"), k, most)
    return in_rows.unionByName(_seeds_by_join(pairs.join(apart, "id", "left_semi"), k, most))


def depth(spans: DataFrame, key: str = "read_id", most: int = MOST_DEPTH) -> DataFrame:
    """(key, b, e, depth): the parts of a read with equal numbers of spans (b, e) over them, most at most; none where there are none.

    By sums over the ends of spans, one row for each place where spans begin or end.
    """
    ends = spans.where("b < e").select(key, F.explode(F.array(F.struct(F.col("b").alias("at"), F.lit(1).alias("d")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("d")))).alias("x"))
    steps = ends.groupBy(key, F.col("x.at").alias("b")).agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy(key).orderBy("b")
    out = steps.withColumn("e", F.lead("b").over(w)).withColumn("depth", F.least(F.sum("d").over(w), F.lit(most)))
    return out.where("e is not null and depth > 0").select(key, "b", "e", "depth")


def capped_hits(hits: DataFrame, most: int = MOST_HITS) -> DataFrame:
    """hits (read_id, hit, b, e, score) with kept: from the best score on, a hit stays unless one that stays holds it on the read, or most do over its whole length.

    Ties go by hit. The state of a read is its hits' ends, so a read is one group.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        order = rows.sort_values(["score", "hit"], ascending=[False, True], kind="stable")
        places = np.unique(np.concatenate((rows["b"], rows["e"])))
        over = np.zeros(len(places), np.int64)
        kept, spans = [], []
        for b, e in zip(order["b"], order["e"]):
            i, j = np.searchsorted(places, (b, e))
            ok = not any(x <= b and e <= y for x, y in spans) and (over[i:j] < most).any()
            if ok:
                over[i:j] += 1
                spans.append((b, e))
            kept.append(bool(ok))
        return order.assign(kept=kept)[["read_id", "hit", "kept"]]

    marked = hits.select("read_id", "hit", "b", "e", "score").groupBy("read_id").applyInPandas(run, "read_id long, hit long, kept boolean")
    return hits.join(marked, ["read_id", "hit"])


def site_candidates(hits: DataFrame, query_sites: Column, subject_sites: Column, within: int = 50, least: int = LEAST) -> DataFrame:
    """hits (id, qoff, qend, soff, send, ...) with qb, qe, sb, se: sites near both starts with sites near both ends.

    Starts lie within bases of (qoff, soff), ends of (qend, send). A candidate
    has least bases at least on either side; of those of one start (qb, sb) the
    one whose ends are nearest stays, the left one in ties.
    """
    near = lambda sites, pos: F.filter(sites, lambda s: F.abs(s - pos) <= within)
    grid = lambda q, s: F.flatten(F.transform(q, lambda a: F.transform(s, lambda b: F.struct(a.alias("q"), b.alias("s")))))
    starts = grid(near(query_sites, F.col("qoff")), near(subject_sites, F.col("soff")))
    ends = grid(near(query_sites, F.col("qend")), near(subject_sites, F.col("send")))
    out = hits.withColumn("_x", F.explode(starts)).withColumn("_y", F.explode(ends))
    out = out.where((F.col("_y.q") - F.col("_x.q") >= least) & (F.col("_y.s") - F.col("_x.s") >= least))
    out = out.select(*hits.columns, F.col("_x.q").alias("qb"), F.col("_y.q").alias("qe"), F.col("_x.s").alias("sb"), F.col("_y.s").alias("se"))
    away = F.abs(F.col("qe") - F.col("qend")) + F.abs(F.col("se") - F.col("send"))
    first = F.row_number().over(Window.partitionBy("id", "qoff", "soff", "qb", "sb").orderBy(away, "qe", "se"))
    return out.withColumn("_n", first).where("_n = 1").drop("_n")


def adjacent(frags: DataFrame, order: list[str]) -> DataFrame:
    """frags (read_id, sid, strand, b, e, sb, se) with gap, the bases from the one before in the read (less than 0: they overlap), and colinear.

    Colinear: the same contig and strand, and both ends further along than its. Null in a read's first one.
    """
    w = Window.partitionBy("read_id").orderBy(*order)
    before = F.lag(F.struct("sid", "strand", "sb", "se", "e")).over(w)
    out = frags.withColumn("_p", before)
    along = (F.col("_p.sid") == F.col("sid")) & (F.col("_p.strand") == F.col("strand")) & (F.col("sb") > F.col("_p.sb")) & (F.col("se") > F.col("_p.se"))
    return out.withColumn("gap", F.col("b") - F.col("_p.e")).withColumn("colinear", F.when(F.col("_p").isNotNull(), along)).drop("_p")


def merged_seed_lists(seeds: DataFrame, by: list[str]) -> DataFrame:
    """Of seeds (by, part, qoff, soff) of colinear hits, one list: parts in order, without seeds that aren't past all earlier ones on both sides."""
    w = Window.partitionBy(*by).orderBy("part", "qoff", "soff").rowsBetween(Window.unboundedPreceding, -1)
    past = (F.col("qoff") > F.coalesce(F.max("qoff").over(w), F.lit(-1))) & (F.col("soff") > F.coalesce(F.max("soff").over(w), F.lit(-1)))
    return seeds.withColumn("_ok", past).where("_ok").drop("_ok")


def subset_of(a: Column, b: Column) -> Column:
    """Whether array a has nothing that b lacks."""
    return F.size(F.array_except(a, b)) == 0
