"""python -m catena.cli COMMAND ...: the engine's commands over files.

Inputs may be any path that Spark reads; an output is a folder.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catena.functions import dna
from catena.operators import fragments as fr
from catena.operators import index as ix
from catena.operators import inference as inf
from catena.operators import sites as st
from catena.operators.mapper import fragments
from catena.operators.simulate import simulate
from catena.sources import text as tx


def contigs(spark: SparkSession, path: str) -> DataFrame:
    """Contigs of FASTA files, numbered in file order; empty ones are left out, a repeated name is an error."""
    refs = tx.read_fasta(spark, path, place=True).where("seq <> ''").select("name", F.length("seq").alias("len"), "seq", *tx.PLACE)
    twice = refs.groupBy("name").count().where("count > 1").head()
    if twice:
        raise ValueError(f"the name {twice['name']!r} is that of {twice['count']} contigs")
    return fr.union_numbered([refs], tx.PLACE).select(F.col("read_id").alias("sid"), "name", "len", "seq")


def reads(spark: SparkSession, path: str) -> DataFrame:
    """Reads of a file, or of those that a list file names, with read_id from 0 in file order over all of them."""
    parts = []
    for one in tx.expand(spark, path):
        fastq = tx.guess_format(spark, one) == "fastq"
        got = (tx.read_fastq if fastq else tx.read_fasta)(spark, one, place=True)
        parts.append(got if fastq else got.withColumn("qual", F.repeat(F.lit("!"), F.length("seq"))))
    return fr.union_numbered(parts, tx.PLACE).drop("file", *tx.PLACE)


def mapped(spark: SparkSession, own: DataFrame, refs: DataFrame, index: DataFrame, motif: str | None) -> DataFrame:
    """Fragments of reads with names, lengths, the nearest sites of their ends and SAM flags."""
    f = fragments(own, refs, ix.seeds(own, index), **({"motif": motif} if motif else {}))
    motif = motif or "GATC"
    f = f.join(refs.select("sid", F.col("name").alias("sname"), F.col("len").alias("_slen"), dna.site_array(F.col("seq"), motif).alias("s")), "sid")
    f = f.join(own.select("read_id", F.col("name").alias("qname"), F.col("seq").alias("_seq"), F.col("qual").alias("_qual"), dna.site_array(F.col("seq"), motif).alias("q")), "read_id")
    near = {n: dna.nearest_in(F.col(x), F.col(c)) for n, x, c in (("q_left", "q", "qb"), ("q_right", "q", "qe"), ("s_left", "s", "sb"), ("s_right", "s", "se"))}
    return f.withColumns(near)


def frag_sam(f: DataFrame) -> DataFrame:
    """Lines of fragment SAM: a record for each fragment, named <read>_<fragment id>, its own bases and no clips."""
    back = F.col("strand") == 1
    cut = lambda c: F.substring(c, F.col("qb") + 1, F.col("qe") - F.col("qb"))
    f = fr.sam_flags(f.withColumn("score", F.col("map_score")), ["qb", "qe", "sid", "sb"])
    f = fr.numbered(f, ["qb", "qe", "sid", "sb"])
    name = F.concat(F.col("qname"), F.lit("_"), dna.fragment_id(F.col("read_id"), F.col("frag_id"), F.col("sid"), F.col("sb")))
    f = f.withColumn("qname", name).withColumn("sl", F.col("_slen")).withColumn("seq", F.when(back, dna.read_reverse_complement(cut("_seq"))).otherwise(cut("_seq")))
    return tx.sam_lines(f.withColumn("qual", F.when(back, F.reverse(cut("_qual"))).otherwise(cut("_qual"))), fragments=True)


def inferred(own: DataFrame, refs: DataFrame, index: DataFrame) -> str:
    """The motif that most fragments of the reads speak for; an error if none wins."""
    f = fragments(own, refs, ix.seeds(own, index)).join(own.select("read_id", F.col("seq").alias("qseq")), "read_id").join(refs.select("sid", F.col("seq").alias("sseq")), "sid")
    got = inf.infer_enzyme(f)
    if got is None:
        raise ValueError("no enzyme wins on these reads; name it with -e")
    return dna.parse_enzyme(got)[0]


def sam_fragments(spark: SparkSession, path: str) -> DataFrame:
    """Fragments of a SAM file of fragments, by their names and tags; sb and se on the contig."""
    s = tx.mapped_primary(tx.read_sam(spark, path))
    i = dna.parse_fragment_id(F.col("qname"))
    rows = s.select(i.alias("i"), F.col("rname").alias("contig"), "mapq", "flag", (F.col("pos") - 1).cast("long").alias("sb"), dna.cigar_span(F.col("cigar"), "MDN=X").alias("n"), F.col("tags")["ds"].alias("ds"), F.col("tags")["vS"].alias("vS"), F.col("tags")["vE"].alias("vE"))
    return rows.select(F.col("i.read").alias("read_id"), F.col("i.frag_id").alias("ord"), F.col("contig").alias("sid"), "mapq", "flag", "sb", (F.col("sb") + F.col("n")).alias("se"), "ds", "vS", "vE")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="catena")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [c := sub.add_parser(name), *(c.add_argument(a) for a in args)][0]
    c = add("index", "ref", "out")
    c.add_argument("-k", type=int, default=ix.K)
    c.add_argument("-w", type=int, default=ix.STEP)
    c.add_argument("-f", type=float, default=ix.FRACTION)
    c = add("map", "ref", "reads", "out")
    c.add_argument("-e", "--enzyme", help="inferred from the reads unless named")
    c.add_argument("--index", help="of the index command; made from ref unless named")
    c.add_argument("--format", choices=["paf", "frag-sam"], default="paf")
    add("sites", "ref", "enzyme", "out")
    add("chr-names", "ref")
    add("extract-chr", "ref", "out").add_argument("names", nargs="+")
    c = add("extract-fastq", "reads", "out")
    c.add_argument("-n", type=int)
    c.add_argument("-s", default="1e")
    add("fix-sam", "sam", "out")
    add("sam-stats", "sam")
    add("frag-stats", "sam")
    add("ddf-score-stats", "sam")
    add("eval", "sam", "reads")
    add("sim", "ref", "enzyme", "out").add_argument("-n", type=int, default=20_000)
    add("sim-stats", "reads")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "index":
        ix.build_index(contigs(spark, a.ref), a.k, a.w, a.f).write.parquet(a.out)
    elif a.command == "map":
        refs, own = contigs(spark, a.ref), reads(spark, a.reads)
        index = spark.read.parquet(a.index) if a.index else ix.build_index(refs)
        motif = dna.parse_enzyme(a.enzyme)[0] if a.enzyme else inferred(own, refs, index)
        f = mapped(spark, own, refs, index, motif)
        (tx.paf_lines(f) if a.format == "paf" else frag_sam(f)).write.text(a.out)
    elif a.command == "sites":
        st.site_table(contigs(spark, a.ref), a.enzyme).write.parquet(a.out)
    elif a.command == "chr-names":
        print(*sorted(r["name"] for r in contigs(spark, a.ref).select("name").collect()))  # names alone
    elif a.command == "extract-chr":
        tx.fasta_lines(contigs(spark, a.ref).where(F.col("name").isin(a.names))).write.text(a.out)
    elif a.command == "extract-fastq":
        got = tx.read_fastq(spark, a.reads, place=True).withColumn("n", F.length("seq").cast("long"))
        tx.fastq_lines(fr.prefix_by_sum(got, tx.PLACE, "n", dna.parse_size(a.s), a.n)).write.text(a.out)
    elif a.command == "fix-sam":
        lines = spark.read.text(a.sam)
        q = F.split("value", "\t")[4].cast("int")
        lines.where(F.col("value").startswith("@") | q.between(0, 60)).write.text(a.out)
        kept = F.sum(q.between(0, 60).cast("long"))
        lines.where(~F.col("value").startswith("@")).agg(kept.alias("kept"), F.count(F.lit(1)).alias("records"), (1 - kept / F.count(F.lit(1))).alias("dropped")).show()
    elif a.command == "sam-stats":
        s = tx.mapped_primary(tx.read_sam(spark, a.sam))
        f = s.select(F.col("qname").alias("read_id"), F.col("rname").alias("sid"), "mapq", F.col("pos").alias("sb"))
        fr.contact_counts(f, ["sb", "sid", "mapq"]).show()
    elif a.command == "frag-stats":
        f = sam_fragments(spark, a.sam)
        fr.contact_counts(f, ["ord"]).show()
        fr.end_support(f, F.col("sb") == F.col("vS"), F.col("se") == F.col("vE")).show()
    elif a.command == "ddf-score-stats":
        fr.histogram(sam_fragments(spark, a.sam), F.col("se") - F.col("sb"), F.col("ds")).show(100)
    elif a.command == "eval":
        f = sam_fragments(spark, a.sam)
        heads = reads(spark, a.reads).select(F.col("name").alias("read_id"), F.concat_ws(" ", "name", "comment").alias("header"))
        truth = tx.parse_truth(heads).select("read_id", F.col("chr").alias("sid"), "ord", "sb", "se")
        fr.evaluate(f, truth, ["ord"]).show(vertical=True)
    elif a.command == "sim":
        out = simulate(contigs(spark, a.ref), a.enzyme, a.n)
        out.select(F.concat(F.lit(">"), F.split_part("header", F.lit(" "), F.lit(2)), F.lit(" x "), F.split_part("header", F.lit(" "), F.lit(3)), F.lit("\n"), "seq").alias("value")).write.text(a.out)
    elif a.command == "sim-stats":
        heads = reads(spark, a.reads).select("read_id", F.concat_ws(" ", "name", "comment").alias("header"))
        tx.truth_stats(tx.parse_truth(heads)).show()


if __name__ == "__main__":
    main()
