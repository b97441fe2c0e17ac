"""Reads to fragments: seeds, chains, alignments, qualities and the covering path.

Seeds come from a distributed equi-join. A read's seeds, which the repeat
filters bound, meet in one task with its sequence and the contigs they hit.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catena.operators.kernels import ChainOptions, align, best_quality, chain, cover, trim_ends
from catena.operators.trimming import Fragment, trim, trim_query, trim_subject

CHAINS = "read_id long, chain_id int, sid long, strand int, qb int, qe int, sb int, se int, score int"
FRAGMENTS = "read_id long, frag_id int, qb int, qe int, qlen int, sid long, strand int, sb int, se int, sl int, mapq int, ddf_score int, map_score int, pi double, cigar string, matches int, columns int"


def _chains(pdf: pd.DataFrame, opt: ChainOptions) -> list[tuple]:
    out = []
    for (sid, strand), g in pdf.sort_values(["sid", "strand", "soff", "qoff"]).groupby(["sid", "strand"]):
        s, q = g["soff"].to_numpy(), g["qoff"].to_numpy()
        for path in chain(s, q, opt):
            a, b = path[0], path[-1]
            out.append((int(sid), int(strand), int(q[a] + 1 - opt.k), int(q[b] + 1), int(s[a] + 1 - opt.k), int(s[b] + 1), len(path)))
    return sorted(out, key=lambda c: (-c[6], *c))


def chains(seeds: DataFrame, opt: ChainOptions = ChainOptions()) -> DataFrame:
    """Chains of each read by falling number of seeds; on the reverse strand query places are those of the reverse complement."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _chains(pdf, opt)
        read = int(pdf["read_id"].iloc[0])
        return pd.DataFrame([(read, k, *c) for k, c in enumerate(rows)], columns=[c.split()[0] for c in CHAINS.split(", ")])

    return seeds.groupBy("read_id").applyInPandas(run, CHAINS)


class _Sites:
    """Nearest site of a place in a sequence, ties to the left; -1 without a motif."""

    def __init__(self, seq: str, motif: str | None):
        self.at = [0, *(m.start() for m in re.finditer(f"(?={motif})", seq) if m.start()), len(seq)] if motif else []

    def near(self, place: int) -> int:
        if not self.at:
            return -1
        k = bisect_right(self.at, place)
        left, right = self.at[max(0, k - 1)], self.at[min(k, len(self.at) - 1)]
        return left if place - left <= right - place else right


def _fragments(read: int, seq: str, hits: list[tuple], slices: dict[int, tuple[str, int]], motif: str | None) -> Iterator[tuple]:
    """Aligned, end-trimmed, rated, chosen and overlap-trimmed hits of one read.

    From the choice on, places are those of the forward read and of the
    contig's strand; they are turned to the forward contig at the end.
    """
    n, found = len(seq), []
    back = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for sid, strand, qb, qe, sb, se, score in hits:
        subject, size = slices[sid]
        _, text = align((back if strand else seq)[qb:qe], subject[sb:se])
        ops, (ql, sl), (qr, sr) = trim_ends([(int(x), op) for x, op in re.findall(r"(\d+)(\D)", text)])
        if not ops:
            continue
        b, e, sb, se = qb + ql, qe - qr, sb + sl, se - sr
        if strand:
            b, e, sb, se, ops = n - e, n - b, size - se, size - sb, ops[::-1]
        found.append((Fragment(b, e, sid, strand, sb, se, tuple(ops)), score, _value(ops)))
    if not found:
        return
    b, e = (np.array([getattr(f, k) for f, _, _ in found]) for k in ("qb", "qe"))
    score, value = np.array([x[1] for x in found]), np.array([x[2] for x in found])
    quality = best_quality(b, e, score, np.maximum(value, 1))
    own, sites = _Sites(seq, motif), {}
    chosen = {}
    for i in cover(b, e, value, n):
        f = found[i][0]
        key = (f.sid, f.strand)
        if key not in sites:
            subject = slices[f.sid][0]
            sites[key] = _Sites(subject[::-1].translate(str.maketrans("ACGT", "TGCA")) if f.strand else subject, motif)
        f = replace(f, sites=(own.near(f.qb), own.near(f.qe), sites[key].near(f.sb), sites[key].near(f.se)))
        chosen[f.sid, f.strand, f.sites, f.qb, f.qe] = (f, i)
    picked = [f for f, _ in chosen.values()]
    kept = trim(picked) if motif else sorted(trim_subject(trim_query(picked)), key=lambda f: f.qb)
    origin = [(f, i) for f, i in chosen.values()]
    for k, f in enumerate(kept):
        # A trimmed fragment lies within the one that it was cut from.
        i = next(i for g, i in origin if (g.sid, g.strand, g.sites) == (f.sid, f.strand, f.sites) and g.qb <= f.qb and f.qe <= g.qe)
        size = slices[f.sid][1]
        ops = f.ops[::-1] if f.strand else f.ops
        sb, se = (size - f.se, size - f.sb) if f.strand else (f.sb, f.se)
        matches, columns = sum(x for x, o in ops if o == "="), sum(x for x, _ in ops)
        yield read, k, f.qb, f.qe, n, f.sid, f.strand, sb, se, size, int(quality[i]), int(score[i]), _value(ops), 100.0 * matches / columns, "".join(f"{x}{o}" for x, o in ops), matches, columns


def _value(ops) -> int:
    return sum(x * (2 if o == "=" else -5 if o == "X" else -4) for x, o in ops)


def fragments(reads: DataFrame, refs: DataFrame, seeds: DataFrame, opt: ChainOptions = ChainOptions(), most: int = 1000, motif: str | None = None) -> DataFrame:
    """Fragments of each read in order: the chains that cover it best, without overlaps, 50 bases at least.

    With a motif, ends on its sites win where fragments overlap, and short ones
    far from any site are dropped.

    A read's chains are joined with the contigs they hit, each once, so that a
    task holds one read with what it needs of the reference.
    """
    names = [c.split()[0] for c in FRAGMENTS.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        slices = {int(s): (x, len(x)) for s, x in zip(pdf["sid"], pdf["subject"]) if x is not None}
        hits = [tuple(int(r[c]) for c in ("sid", "strand", "qb", "qe", "sb", "se", "score")) for _, r in pdf.sort_values("chain_id").head(most).iterrows()]
        return pd.DataFrame(list(_fragments(int(pdf["read_id"].iloc[0]), pdf["seq"].iloc[0], hits, slices, motif)), columns=names)

    found = chains(seeds, opt)
    subject = refs.select("sid", F.col("seq").alias("subject"))
    first = F.min("chain_id").over(Window.partitionBy("read_id", "sid")) == F.col("chain_id")
    rows = found.withColumn("hold", F.when(first, F.col("sid"))).join(subject.withColumnRenamed("sid", "hold"), "hold", "left").drop("hold")
    own = reads.select("read_id", F.regexp_replace(F.upper("seq"), "[^ACGT]", "A").alias("seq"))  # ambiguous bases of reads count as A
    return rows.join(own, "read_id").groupBy("read_id").applyInPandas(run, FRAGMENTS)
