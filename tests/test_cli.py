import random

import pytest
from catena import cli


def test_index_map_and_extract(spark, tmp_path, capsys):
    rng = random.Random(8)
    seqs = {f"chr{k}": "".join(rng.choices("ACGT", k=3000)) for k in range(3)}
    (tmp_path / "ref.fa").write_text("".join(f">{n} note\n{s[:1500]}\n{s[1500:]}\n" for n, s in seqs.items()))
    (tmp_path / "reads.fa").write_text(f">r1\n{seqs['chr1'][200:900]}{seqs['chr2'][1000:1600]}\n>r2\n{seqs['chr0'][5:700]}\n")
    ref = f"{tmp_path}/ref.fa"
    cli.main(["chr-names", ref])
    assert capsys.readouterr().out.strip().endswith("chr0 chr1 chr2")
    cli.main(["index", ref, f"{tmp_path}/index"])
    index = spark.read.parquet(f"{tmp_path}/index")
    assert index.columns == ["kmer", "sid", "pos", "rev"] and 2900 < index.count() <= 3 * 996
    cli.main(["extract-chr", ref, f"{tmp_path}/one", "chr2"])
    assert [r.value for r in spark.read.text(f"{tmp_path}/one").collect()] == [">chr2", seqs["chr2"]]
    cli.main(["map", ref, f"{tmp_path}/reads.fa", f"{tmp_path}/paf", "-e", "DpnII"])
    lines = sorted(r.value.split("\t")[:9] for r in spark.read.text(f"{tmp_path}/paf").collect())
    assert [(x[0], x[5]) for x in lines] == [("r1", "chr1"), ("r1", "chr2"), ("r2", "chr0")]
    assert abs(int(lines[0][7]) - 200) < 30 and abs(int(lines[0][8]) - 900) < 30
    cli.main(["sites", ref, "DpnII", f"{tmp_path}/sites"])
    assert spark.read.parquet(f"{tmp_path}/sites").where("pos = 3001").count() == 3


def test_map_with_index_and_fragment_commands(spark, tmp_path, capsys):
    rng = random.Random(9)
    seqs = {f"chr{k}": "".join(rng.choices("ACGT", k=6000)) for k in (2, 0, 1)}
    (tmp_path / "ref.fa").write_text("".join(f">{n}\n{s}\n" for n, s in seqs.items()))
    spans = [("chr2", 300, 1500), ("chr0", 2000, 3100), ("chr2", 4000, 5200)]
    seq = "".join(seqs[c][b:e] for c, b, e in spans)
    head = "sim1 p0_2_1 " + ";".join(f"{c}-{b}-{e}-0-0" for c, b, e in spans)
    (tmp_path / "a.fq").write_text(f"@{head}\n{seq}\n+\n{'I' * len(seq)}\n")
    (tmp_path / "b.fa").write_text(">z second\nACGTACGTAA\n>y\nCCGT\n")
    (tmp_path / "list.txt").write_text(f"# two files\n{tmp_path}/a.fq\n{tmp_path}/b.fa\n")
    ref, listed = f"{tmp_path}/ref.fa", f"{tmp_path}/list.txt"
    assert [(r.sid, r.name) for r in cli.contigs(spark, ref).orderBy("sid").collect()] == [(0, "chr2"), (1, "chr0"), (2, "chr1")]
    assert [(r.read_id, r.name) for r in cli.reads(spark, listed).orderBy("read_id").collect()] == [(0, "sim1"), (1, "z"), (2, "y")]
    cli.main(["index", ref, f"{tmp_path}/index"])
    cli.main(["map", ref, listed, f"{tmp_path}/sam", "--index", f"{tmp_path}/index", "--format", "frag-sam", "-e", "DpnII"])
    records = sorted(r.value.split("\t") for r in spark.read.text(f"{tmp_path}/sam").collect())
    assert [x[0].rsplit(":", 1)[0] for x in records] == [f"sim1_0000000000:000000000{k}:000000000{s}" for k, s in enumerate((0, 1, 0))]
    for x, (c, b, e) in zip(records, spans):
        assert x[2] == c and abs(int(x[3]) - 1 - b) < 30 and len(x[9]) == len(x[10]) and x[9] in seqs[c]
    capsys.readouterr()
    cli.main(["eval", f"{tmp_path}/sam", f"{tmp_path}/a.fq"])
    out = capsys.readouterr().out
    assert "n_true             | 3" in out and "n_right            | 3" in out
    cli.main(["frag-stats", f"{tmp_path}/sam"])
    cli.main(["ddf-score-stats", f"{tmp_path}/sam"])
    assert "1150" in capsys.readouterr().out
    (tmp_path / "twice.fa").write_text(">a\nACGT\n>a\nACGT\n")
    with pytest.raises(ValueError):
        cli.contigs(spark, f"{tmp_path}/twice.fa")


def test_first_records_in_file_order(spark, tmp_path):
    names = ["zeta", "alpha", "mid", "beta"]
    (tmp_path / "r.fq").write_text("".join(f"@{n} x\n{'ACGT' * 5}\n+\n{'I' * 20}\n" for n in names))
    cli.main(["extract-fastq", f"{tmp_path}/r.fq", f"{tmp_path}/out", "-n", "2"])
    got = sorted(line.value for line in spark.read.text(f"{tmp_path}/out").collect() if line.value.startswith("@"))
    assert got == ["@alpha", "@zeta"]
