"""Which enzyme cut the reads: evidence at the ends of fragments, and the vote over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catena.functions import dna
from catena.operators.sites import vote

#: An end counts if it is so far from the ends of its read and contig; the motif has to lie within AROUND bases of it.
FAR, AROUND = 200, 30
#: Fragments that are asked: mapping quality and length.
MAPQ, LENGTH = 10, 200


def has_motif(seq: Column, at: Column, motif: str, around: int = AROUND) -> Column:
    """Whether motif lies within around bases of a place."""
    begin = F.greatest(at - around, F.lit(0))
    return F.instr(F.substring(seq, begin.cast("int") + 1, (at + around - begin).cast("int")), motif) > 0


def evidence(frags: DataFrame, motif: str, far: int = FAR, around: int = AROUND) -> Column:
    """Whether both ends of a fragment (qseq, qb, qe, sseq, sb, se) speak for motif, on the read and on the contig."""
    ends = []
    for q, s in (("qb", "sb"), ("qe", "se")):
        inside = [(F.col(c) >= far) & (F.col(c) <= F.length(seq) - far) for c, seq in ((q, "qseq"), (s, "sseq"))]
        ends.append(inside[0] & inside[1] & has_motif(F.col("qseq"), F.col(q), motif, around) & has_motif(F.col("sseq"), F.col(s), motif, around))
    return ends[0] & ends[1]


def enzyme_votes(frags: DataFrame, mapq: int = MAPQ, length: int = LENGTH) -> DataFrame:
    """(enzyme, votes, winner) over fragments (qseq, qb, qe, sseq, sb, se, mapq) of mapq and length at least; a vote for each that speaks for it."""
    asked = frags.where((F.col("mapq") >= mapq) & (F.col("qe") - F.col("qb") >= length))
    sums = [F.coalesce(F.sum(evidence(asked, dna.parse_enzyme(e)[0]).cast("long")), F.lit(0)).alias(e) for e in sorted(dna.ENZYMES)]
    row = asked.agg(*sums)
    return vote(row.select(F.explode(F.array(*[F.struct(F.lit(e).alias("enzyme"), F.col(e).alias("votes")) for e in sorted(dna.ENZYMES)])).alias("x")).select("x.enzyme", "x.votes"))


def infer_enzyme(frags: DataFrame) -> str | None:
    """The winner's name, or None if none has over twice the votes of the next."""
    got = enzyme_votes(frags).where("winner").head()
    return got["enzyme"] if got and got["votes"] > 0 else None
