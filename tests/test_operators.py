import itertools
import random

import numpy as np
import pytest
from catena.functions import dna
from catena.operators import fragments as fr
from catena.operators import index as ix
from catena.operators import sites as st
from catena.operators.kernels import align, best_quality, chain, cover, mapping_quality, trim_ends
from catena.operators.mapper import chains, fragments
from catena.operators.simulate import simulate
from catena.sources.text import parse_truth
from pyspark.sql import functions as F


def col(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).head().y


def test_sites_and_enzymes(spark):
    got = [col(spark, s, lambda c: dna.site_array(c, "GATC")) for s in ("AAGATCTTGATC", "GATCAA", "GA")]
    assert got == [[0, 2, 8, 12, 13], [0, 6, 7], [0, 2, 3]]
    assert dna.parse_enzyme("C^CATGG") == ("CCATGG", 1) and dna.parse_enzyme("NlaIII") == ("CATG", 4)
    for bad in ("GATC", "^GAXC", "^GATG", "^GATCGATC"):
        with pytest.raises(ValueError):
            dna.parse_enzyme(bad)
    near = spark.createDataFrame([(1, [0, 10, 11], p) for p in (5, 6, 10)], "sid int, sites array<int>, pos int").select(dna.nearest_in(F.col("sites"), F.col("pos")).alias("s"))
    assert [r.s for r in near.collect()] == [0, 10, 10]


def test_scalars(spark):
    assert col(spark, "AACN", dna.reverse_complement) == "NGTT" and col(spark, "ACN", dna.read_reverse_complement) == "TGT"
    assert [col(spark, k, dna.canonical) for k in ("AAC", "GTT", "AT")] == ["AAC", "AAC", None]
    assert col(spark, "ACGT", dna.kmer_hash) == 27 and col(spark, "acgtn-", dna.encode) == "012345"
    assert dna.parse_size("10g") == 10_000_000_000 and dna.parse_size("1KiB") == 1024 and dna.parse_size("1.5M") == 1_500_000
    assert dna.format_size(1_500_000) == "1.5MB"
    with pytest.raises(ValueError):
        dna.parse_size("x")
    row = spark.sql("select 1L a, 0L b, 0L c, 1794201L d").select(dna.fragment_id(*map(F.col, "abcd")).alias("i")).head()
    assert row.i == "0000000001:0000000000:0000000000:0001794201"
    assert tuple(col(spark, "my_read_" + row.i, dna.parse_fragment_id)) == ("my_read", 1, 0, 0, 1794201)
    assert col(spark, "a,,b,", lambda c: dna.split_collapsed(c, ",")) == ["a", "b"]


def test_chain_rules():
    s = np.array([14, 15, 16, 60, 61, 500])
    q = np.array([14, 15, 16, 62, 63, 20])
    assert chain(s, q) == [[0, 1, 2, 3, 4]]
    assert chain(np.array([14, 14]), np.array([1, 2])) == []


def test_mapping_quality():
    one = np.array([1])
    assert mapping_quality(np.array([0]), np.array([100]), 50 * one, 50 * one, 160).tolist() == [60]
    got = best_quality(np.array([0, 0, 200]), np.array([100, 100, 300]), np.array([50, 25, 9]), np.array([180, 90, 20]))
    assert got.tolist()[1:] == [0, 60] and 0 < got[0] <= 60


def test_cover_is_the_cheapest():
    rng = random.Random(1)
    gap = lambda g: 0 if g == 0 else 4 + 2 * g
    for _ in range(30):
        n = 6
        b = np.array([rng.randrange(500) for _ in range(n)])
        e = b + np.array([rng.randrange(60, 300) for _ in range(n)])
        score = np.array([rng.randrange(400) for _ in range(n)])

        def cost(path):
            c, last = 0, None
            for i in path:
                if last is not None and (b[i] - b[last] < 50 or e[i] - e[last] < 50):
                    return float("inf")
                c += gap(int(b[i] if last is None else abs(b[i] - e[last]))) - score[i]
                last = i
            return c + gap(int(900 - e[last]))

        order = sorted(range(n), key=lambda i: (b[i], e[i]))
        best = min(cost(p) for k in range(1, n + 1) for p in itertools.combinations(order, k))
        assert cost(cover(b, e, score, 900)) == best


def test_align_against_levenshtein(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choices("ACGT", k=rng.randrange(40))), "".join(rng.choices("ACGT", k=rng.randrange(40)))) for _ in range(60)]
    want = [r.d for r in spark.createDataFrame(pairs, "a string, b string").select(F.levenshtein("a", "b").alias("d")).collect()]
    import re

    for (a, b), d in zip(pairs, want):
        got, cigar = align(a, b)
        assert got == d
        ops = [(int(n), o) for n, o in re.findall(r"(\d+)(\D)", cigar)]
        assert sum(n for n, o in ops if o in "=XI") == len(a) and sum(n for n, o in ops if o in "=XD") == len(b)
        assert sum(n for n, o in ops if o != "=") == d
        assert align(a, a + b, free_end=True)[0] == 0
    assert trim_ends([(3, "="), (1, "X"), (9, "="), (2, "I"), (4, "=")]) == ([(9, "=")], (4, 4), (6, 4))


def test_prefix_and_stats(spark):
    df = spark.createDataFrame([(k, 60) for k in range(3)], "ord int, len int")
    assert sorted(r.ord for r in fr.prefix_by_sum(df, ["ord"], "len", 100).collect()) == [0, 1]
    row = fr.length_stats(spark.createDataFrame([(x,) for x in (5, 1, 9, 7)], "len int")).head()
    assert (row.n, row.total, row.median, row.n25, row.n75, row["mean"]) == (4, 22, 7, 5, 9, 5)
    votes = spark.createDataFrame([("a", 10), ("b", 5)], "enzyme string, votes long")
    assert [r.winner for r in st.vote(votes).collect()] == [False, False]


def test_simulated_reads_are_mapped(spark):
    rng = random.Random(5)
    refs = spark.createDataFrame([(k, f"chr{k}", 8000, "".join(rng.choices("ACGT", k=8000))) for k in range(4)], "sid long, name string, len int, seq string")
    reads = simulate(refs, "DpnII", 25).cache()
    truth = parse_truth(reads).select("read_id", F.col("ord").alias("ord"), F.regexp_extract("chr", r"(\d+)", 1).cast("long").alias("sid"), "sb", "se")
    seeds = ix.seeds(reads, ix.build_index(refs))
    assert chains(seeds).count() > 0.8 * truth.count()  # neighbouring fragments make one chain
    got = fragments(reads, refs, seeds, motif="GATC")
    row = fr.evaluate(got.withColumn("strand", F.col("strand").cast("long")), truth, ["qb", "qe", "sid", "sb"]).head()
    assert row.precision > 0.9 and row.recall > 0.85 and row.boundary_precision > 0.9
    for r in got.collect():
        assert 0 <= r.qb < r.qe <= r.qlen and 0 <= r.sb < r.se <= r.sl and 0 <= r.mapq <= 60 and r.qe - r.qb >= 50
    spans = sorted((r.read_id, r.qb, r.qe) for r in got.collect())
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(spans, spans[1:]))
