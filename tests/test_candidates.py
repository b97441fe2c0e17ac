import random
from collections import Counter

from catena.functions import dna
from catena.operators import candidates as ca
from catena.operators import fragments as fr
from catena.operators import index as ix
from catena.operators import inference as inf
from catena.operators.trimming import Fragment, trim_subject
from pyspark.sql import functions as F


def test_kmers_by_hand_over_blocks(spark, monkeypatch):
    rng = random.Random(4)
    seqs = [(k, "".join(rng.choices("ACGT" if k % 2 else "ACGTN", k=n))) for k, n in enumerate((0, 14, 15, 40, 700))] + [(9, None)]
    monkeypatch.setattr(ix, "BLOCK", 90)
    df = spark.createDataFrame(seqs, "sid long, seq string")
    back = str.maketrans("ACGT", "TGCA")
    for k, step in ((15, 3), (5, 1), (4, 2)):
        want = set()
        for sid, s in seqs:
            for p in range(0, len(s or "") - k + 1, step):
                f = s[p : p + k]
                r = f.translate(back)[::-1]
                if "N" not in f and f != r:
                    code = int(min(f, r).translate(str.maketrans("ACGT", "0123")), 4)
                    want.add((sid, p, code, f > r))
        got = [tuple(r) for r in ix.kmers(df, "sid", k, step).collect()]
        assert set(got) == want and len(got) == len(want)


def test_capped_hits_by_hand(spark):
    rng = random.Random(6)
    rows = [(r, h, b, b + rng.randrange(20, 200), rng.randrange(50)) for r in range(6) for h in range(30) for b in [rng.randrange(300)]]
    got = {(r.read_id, r.hit): r.kept for r in ca.capped_hits(spark.createDataFrame(rows, "read_id long, hit long, b long, e long, score long")).collect()}
    for read in range(6):
        over, spans = [0] * 600, []
        for _, h, b, e, _ in sorted((x for x in rows if x[0] == read), key=lambda x: (-x[4], x[1])):
            ok = not any(x <= b and e <= y for x, y in spans) and any(d < 3 for d in over[b:e])
            if ok:
                over[b:e] = [d + 1 for d in over[b:e]]
                spans.append((b, e))
            assert got[read, h] == ok
    assert len(got) == len(rows)


def test_gapped_and_identity(spark):
    rows = [("2S3=1X2I2D4=3H", "TTACGTGGACGT", "ACGCAAACGT"), ("60=", "A" * 60, "A" * 60), ("40=9D20=", "C" * 60, "C" * 69)]
    df = spark.createDataFrame(rows, "cigar string, q string, s string")
    cut = F.when(F.col("cigar").startswith("2S"), F.substring("q", 3, 99)).otherwise(F.col("q"))
    got = [tuple(r.x) for r in df.select(dna.gapped(F.col("cigar"), cut, F.col("s")).alias("x")).collect()]
    assert got[0] == ("ACGTGG--ACGT", "ACGC--AAACGT") and got[2] == ("C" * 40 + "-" * 9 + "C" * 20, "C" * 69)
    assert [r.x for r in df.select(dna.effective_identity(F.col("cigar")).alias("x")).collect()] == [0.0, 100.0, 100.0]


def test_subject_overlaps_cut_the_shorter():
    def one(b, e, on):
        return Fragment(sid=0, strand=0, qb=b, qe=e, sb=b, se=e, ops=[(e - b, "=")], sites=(b, e, b, e) if on else (-1, -1, -1, -1))

    ends = lambda fs: [(f.sb, f.se) for f in fs]
    assert ends(trim_subject([one(0, 300, True), one(250, 350, True)])) == [(0, 300), (300, 350)]
    assert ends(trim_subject([one(0, 300, True), one(255, 345, True)])) == [(0, 300)]
    assert ends(trim_subject([one(0, 100, True), one(60, 350, True)])) == [(0, 60), (60, 350)]
    assert ends(trim_subject([one(0, 400, False), one(100, 200, False)])) == [(0, 400)]
    assert ends(trim_subject([one(100, 200, False), one(0, 150, False)])) == [(150, 200), (0, 150)]


def test_ids_stay_whole_and_reads_go_on(spark):
    df = spark.createDataFrame([(7,), (123456789012,)], "x long")
    assert [r[0] for r in df.select(dna.pad10(F.col("x"))).collect()] == ["0000000007", "123456789012"]
    a, b = spark.range(25).select(F.col("id").alias("k")), spark.range(3).select((F.col("id") * 7).alias("k"))
    got = fr.union_numbered([a, b], ["k"]).orderBy("read_id").collect()
    assert [(r.read_id, r.file, r.k) for r in got] == [(k, 0, k) for k in range(25)] + [(25 + k, 1, 7 * k) for k in range(3)]


def test_the_enzyme_that_cut(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(40):
        s = list("".join(rng.choices("AC", k=2000)))
        for at in (500, 1400):
            s[at : at + 4] = "GATC"
        s = "".join(s)
        rows.append((s, 500, 1400, s, 500, 1400, 60))
    rows.append((rows[0][0], 500, 1400, rows[0][0], 500, 1400, 9))
    f = spark.createDataFrame(rows, "qseq string, qb int, qe int, sseq string, sb int, se int, mapq int")
    assert inf.infer_enzyme(f) == "DpnII"
    assert {r.enzyme: r.votes for r in inf.enzyme_votes(f).collect()} == {"DpnII": 40, "HindIII": 0, "NcoI": 0, "NlaIII": 0}
    assert inf.infer_enzyme(f.limit(0)) is None


def _seeds_by_hand(rows, k, most):
    hits, at = [], {}
    for i, q, _ in rows:
        for p in range(len(q or b"") - k + 1):
            at.setdefault((i, q[p : p + k]), []).append(p)
    for i, _, s in rows:
        for p in range(len(s or b"") - k + 1):
            hits += [(i, x, p) for x in at.get((i, s[p : p + k]), []) if i is not None]
    n = Counter((i, p) for i, _, p in hits)
    return sorted(h for h in hits if n[h[0], h[2]] <= most)


def test_local_seeds_by_hand(spark, monkeypatch):
    rng = random.Random(3)
    draw = lambda letters, n: bytes(rng.choices(letters, k=n))
    rows = [(i, q := draw(b"ACGT", n), draw(b"ACGT", 30) + q[n // 3 :] + q[: n // 2]) for i, n in enumerate((0, 3, 4, 40, 300, 900))]
    rows += [(10, b"A" * 30, b"A" * 25), (11, None, b"ACGTACGT"), (12, b"ACGTACGT", None), (None, b"ACGTACGT", b"ACGTACGT"), (13, bytes(range(256)) * 2, bytes(range(256)))]
    twice = [(3, rows[3][2], rows[4][2]), (20, b"ACGTAC" * 4, b"ACGTACC" * 3), (20, b"ACGTAC", b"ACGTACG"), (20, b"ACGTAC", b"ACGTACG")]
    usual, small = (1 << 20, 9, 1 << 18, 1 << 12), (35, 9, 50, 7)
    for data, k, most, sizes in ((rows, 4, 3, usual), (rows, 15, 20, usual), (rows, 1, 8, (1 << 20, 9, 1, 1)), (rows + twice, 4, 3, usual), (rows + twice, 4, 20, small), (rows + twice, 15, 20, (35, 1, 50, 7))):
        for name, value in zip(("LONG", "LISTED", "PLACES", "BLOCK"), sizes):
            monkeypatch.setattr(ca, name, value)
        df = spark.createDataFrame(data, "id long, q binary, s binary")
        assert sorted(map(tuple, ca.local_seeds(df, k, most).collect())) == _seeds_by_hand(data, k, most), (k, most, sizes)


def test_local_seeds_deals_out_no_kmers(spark):
    """What is shuffled follows the rows, not their bases; a repeat is not paired with itself."""
    rng = random.Random(8)
    rows = [(i, s, s) for i in range(20) for s in ["".join(rng.choices("ACGT", k=5000)) if i else "A" * 3000]]
    df = spark.createDataFrame(rows, "id long, q string, s string").localCheckpoint()
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    assert {r.id for r in ca.local_seeds(df).groupBy("id").count().collect()} == set(range(1, 20))
    assert written() - before < 20_000
