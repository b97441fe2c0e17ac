import gzip

from catena.sources import text as tx
from catena.streaming.reads import counts, map_stream, stream_reads


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first one\nACgt\n!skip\nNN;note\n\n>two\n\nAC\n GT\n>bad\n<<<>>>\n")
    got = sorted(tuple(r) for r in tx.read_fasta(spark, f"{tmp_path}/a.fa").collect() if r.name != "bad")
    assert got[:2] == [("one", "first one", "ACGTNN"), ("two", "", "ACGT")]
    with gzip.open(tmp_path / "r.fq.gz", "wt") as f:
        f.write("@r1 x\nACGT\n+\n@III\n@r2\nAC\n+\nII\n")
    assert sorted(tuple(r) for r in tx.read_fastq(spark, f"{tmp_path}/r.fq.gz").collect()) == [("r1", "x", "ACGT", "@III"), ("r2", "", "AC", "II")]
    assert [tx.guess_format(spark, f"{tmp_path}/{f}") for f in ("a.fa", "r.fq.gz")] == ["fasta", "fastq"]


def test_sam_and_paf_round_trip(spark):
    df = spark.sql("select 'q' qname, 100 qlen, 10 qb, 40 qe, 1 strand, 'c' sname, 500 sl, 20 sb, 50 se, 30 matches, 30 `columns`, 60 mapq, 7 ddf_score, 1 read_id, 0 q_left, 100 q_right, 0 s_left, 60 s_right, 3 sid, 2064 flag, '30=' cigar, 'A' seq, 'I' qual")
    line = tx.paf_lines(df).head().value
    assert line.split("\t")[:5] == ["q", "100", "10", "40", "-"] and line.endswith("ds:i:7\tqS:i:0\tqE:i:100\tvS:i:0\tvE:i:60\tqi:i:1")
    assert tx.parse_paf(spark.createDataFrame([(line,)], "value string")).head().sb == 20
    assert tx.sam_lines(df, fragments=True).head().value.split("\t")[1] == "16"
    head = [r.line for r in tx.sam_header(spark.createDataFrame([(0, "c", 500)], "sid int, name string, len int")).orderBy("ord").collect()]
    assert [h[:3] for h in head] == ["@HD", "@SQ", "@PG"]


def test_sam_reader(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@HD\tVN:1.6\nq\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\nq\t16\tc\t5\t60\t3=\t*\t0\t0\tACG\tIII\tds:i:4\tXX:Z:no\n")
    rows = tx.mapped_primary(tx.read_sam(spark, f"{tmp_path}/x.sam")).collect()
    assert len(rows) == 1 and rows[0].pos == 5 and rows[0].tags == {"ds": 4}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fa").write_text(">r1 x\nACGT\n>r2\nAC\n")
    reads = stream_reads(spark, f"{tmp_path}/in")
    seen = []
    map_stream(reads, lambda df, k: seen.extend(tuple(r) for r in counts(df).collect()), f"{tmp_path}/ck").awaitTermination()
    assert seen == [(2, 6)]


def test_bam_round_trip(spark, tmp_path):
    from catena.sources.bam import EOF, bam_bytes, read_bam, records

    rows = [("q1", 16, "c1", 5, 60, "2S3=1X", "ACGTAC", "IIIIII", {"ds": 4, "qS": -1}), ("q2", 4, "*", 0, 0, "*", "ACG", "*", {}), ("q3", 0, "c2", 20000, 7, "2=1D1I", "ACN", "!!~", {"sl": 1 << 30})]
    data = bam_bytes("@HD\tVN:1.6\n", [("c1", 100), ("c2", 50_000)], rows)
    assert list(records(data)) == rows and data.endswith(EOF)
    big = bam_bytes("", [("c1", 100)], [("q", 0, "c1", 1, 1, "4=", "ACGT", "*", {"ds": k}) for k in range(5000)])
    assert [r[8]["ds"] for r in records(big)] == list(range(5000))
    (tmp_path / "x.bam").write_bytes(data)
    assert sorted((r.qname, r.pos, r.tags.get("ds")) for r in read_bam(spark, f"{tmp_path}/x.bam").collect()) == [("q1", 5, 4), ("q2", 0, None), ("q3", 20000, None)]
