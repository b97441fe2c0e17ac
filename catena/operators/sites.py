"""Restriction sites: tables, digestion, nearest and nearby sites, the enzyme vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catena.functions import dna


def site_arrays(refs: DataFrame, enzyme: str) -> DataFrame:
    """(sid, sites): one array for each contig; motifs are palindromes, so both strands have the same."""
    return refs.select("sid", dna.site_array(F.col("seq"), dna.parse_enzyme(enzyme)[0]).alias("sites"))


def site_table(refs: DataFrame, enzyme: str) -> DataFrame:
    """(sid, ord, pos)."""
    return site_arrays(refs, enzyme).select("sid", F.posexplode("sites").alias("ord", "pos"))


def digest(refs: DataFrame, enzyme: str) -> DataFrame:
    """(sid, ord, b, e): fragments between consecutive sites, from 0 to the contig's end."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("sites") - 2), lambda i: F.struct(F.element_at("sites", i).alias("b"), F.element_at("sites", i + 1).alias("e")))
    out = site_arrays(refs, enzyme).select("sid", F.posexplode(pairs).alias("ord", "x"))
    return out.select("sid", "ord", "x.b", "x.e")


def nearest_site(points: DataFrame, sites: DataFrame, pos: str = "pos", into: str = "site") -> DataFrame:
    """points (sid, pos, ...) with the nearest site of their contig; sites is of site_arrays. Ties go left."""
    return points.join(sites, "sid").withColumn(into, dna.nearest_in(F.col("sites"), F.col(pos))).drop("sites")


def nearby_pairs(hits: DataFrame, query_sites: Column, subject_sites: Column, within: int = 50, ddf: float = 0.25) -> DataFrame:
    """hits (qoff, qend, soff, send, ...) with pair: sites near both starts whose lengths to the ends agree.

    Lengths may differ by within bases and by the share ddf of the subject's.
    """
    q = dna.nearby_in(query_sites, F.col("qoff"), F.lit(0), F.col("qend") - 1, within)
    s = dna.nearby_in(subject_sites, F.col("soff"), F.lit(0), F.col("send") - 1, within)
    both = F.flatten(F.transform(q, lambda a: F.transform(s, lambda b: F.struct(a.alias("qsite"), b.alias("ssite")))))

    def agree(p: Column) -> Column:
        qd, sd = F.col("qend") - p["qsite"], F.col("send") - p["ssite"]
        return (F.abs(qd - sd) <= within) & (F.abs(1 - qd / sd) <= ddf)

    return hits.withColumn("pair", F.explode(F.filter(both, agree)))


def vote(counts: DataFrame) -> DataFrame:
    """(enzyme, votes, winner) from rows (enzyme, votes): the first wins if it has over twice the second's votes."""
    w = Window.orderBy(F.desc("votes"), "enzyme")  # one row for each enzyme
    ranked = counts.withColumn("rn", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("votes").over(w), F.lit(0)))
    return ranked.select("enzyme", "votes", ((F.col("rn") == 1) & (F.col("votes") > 2 * F.col("next"))).alias("winner"))
