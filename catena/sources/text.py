"""Sequence and alignment text formats by Spark's text reader: FASTA, FASTQ, SAM, PAF, simulated truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Integer tags of fragment records, in order.
TAGS = ["ds", "qi", "qd", "qs", "qe", "qS", "qE", "ql", "si", "ss", "se", "vS", "vE", "sl"]
#: The columns that hold them, as Spark tells no cases apart: sites at the query's and the subject's ends are q_left and so on.
TAG_COLUMNS = dict(zip(TAGS, ["ddf_score", "read_id", "strand", "qb", "qe", "q_left", "q_right", "qlen", "sid", "sb", "se", "s_left", "s_right", "sl"]))
_SAM = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]


#: Where a line stands: file, the split's offset in it, and the place in the split.
PLACE = ["_file", "_block", "_at"]


def _placed(lines: DataFrame) -> DataFrame:
    return lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))


def expand(spark: SparkSession, path: str) -> list[str]:
    """The paths that a list file names, one a line, or the path itself; # begins a comment."""
    if guess_format(spark, path) != "list":
        return [path]
    return [r["value"].strip() for r in spark.read.text(path).collect() if r["value"].strip() and not r["value"].lstrip().startswith("#")]  # of paths


def read_fasta(spark: SparkSession, path: str, place: bool = False) -> DataFrame:
    """(name, comment, seq) of FASTA files, plain or gzip; with place also PLACE.

    Records may be folded over lines. Lines that begin with ! or # are left
    out, what follows a ; too, and white space; the sequence is upper-cased. A
    record with characters that are no residue for a third of it or more is
    left out. Empty records are kept.
    """
    raw = _placed(spark.read.option("lineSep", "\n>").text(path)).where("value <> ''")
    body = F.regexp_replace(F.regexp_replace("value", r"\r", ""), "^>", "")
    lines = F.split(body, "\n")
    head = F.trim(F.element_at(lines, 1))
    rest = F.transform(F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: ~x.rlike("^[!#;]")), lambda x: F.regexp_replace(x, r";.*|\s", ""))
    got = raw.select(F.split_part(head, F.lit(" "), F.lit(1)).alias("name"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("comment"), F.upper(F.array_join(rest, "")).alias("seq"), *(PLACE if place else []))
    bad = F.length(F.regexp_replace("seq", "[ACGTUMRWSYKVHDBN*-]", ""))
    return got.where((bad == 0) | (3 * bad < F.length("seq") - bad))


def read_fastq(spark: SparkSession, path: str, place: bool = False) -> DataFrame:
    """(name, comment, seq, qual) of FASTQ files with four lines a record, plain or gzip; with place also PLACE.

    Records are put together by line number within a file. Lines are counted by
    split first, so that no task reads more than its split but for gzip.
    """
    lines = _placed(spark.read.text(path))
    sums = lines.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    base = sums.select("_file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = lines.withColumn("_r", F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_at")) - 1).join(base, ["_file", "_block"])
    n = F.col("_base") + F.col("_r")
    fields = [F.max(F.when(F.col("n") % 4 == k, F.col("value"))).alias(c) for k, c in enumerate(("head", "seq", "plus", "qual"))]
    four = numbered.withColumn("n", n).groupBy("_file", F.floor(F.col("n") / 4).alias("_at")).agg(*fields).withColumn("_block", F.lit(0).cast("long"))
    ok = four.where(F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual")))
    return ok.select(F.regexp_extract("head", r"^@(\S*)", 1).alias("name"), F.trim(F.regexp_replace("head", r"^@\S*", "")).alias("comment"), F.upper("seq").alias("seq"), "qual", *(PLACE if place else []))


def guess_format(spark: SparkSession, path: str) -> str:
    """fasta, fastq or list, by the first character that is no blank or comment."""
    first = spark.read.text(path).where(~F.col("value").rlike(r"^\s*([!#;].*)?$")).head()
    return {">": "fasta", "@": "fastq"}.get(first.value.lstrip()[:1] if first else "", "list")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SAM records: the eleven columns, and integer tags as a map."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    number = {"flag", "pos", "mapq", "pnext", "tlen"}
    tags = F.filter(F.slice(parts, 12, F.greatest(F.size(parts) - 11, F.lit(0))), lambda x: x.rlike("^..:i:"))
    tag_map = F.map_from_arrays(F.transform(tags, lambda x: F.substring(x, 1, 2)), F.transform(tags, lambda x: F.regexp_replace(x, "^..:i:", "").cast("long")))
    return rows.select(*[(F.element_at(parts, k + 1).cast("int") if c in number else F.element_at(parts, k + 1)).alias(c) for k, c in enumerate(_SAM)], tag_map.alias("tags"))


def mapped_primary(records: DataFrame, flag: str = "flag") -> DataFrame:
    """Without unmapped (4) and secondary (256) records."""
    return records.where(F.col(flag).bitwiseAND(260) == 0)


def sam_header(contigs: DataFrame, program: str = "catena") -> DataFrame:
    """(ord, line): @HD, an @SQ for each contig in order of sid, @PG."""
    spark = contigs.sparkSession
    sq = contigs.select(F.col("sid").cast("long").alias("ord"), F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.col("len").cast("string")).alias("line"))
    ends = spark.createDataFrame([(-1, "@HD\tVN:1.6\tSO:unknown\tGO:query"), (1 << 62, f"@PG\tID:{program}\tPN:{program}")], "ord long, line string")
    return ends.unionByName(sq)


def _tags(names: list[str]) -> list[Column]:
    return [F.concat(F.lit(f"{t}:i:"), F.col(TAG_COLUMNS[t]).cast("string")) for t in names]


def paf_lines(frags: DataFrame) -> DataFrame:
    """PAF lines of fragments (qname, qlen, qb, qe, strand, sname, sl, sb, se, matches, columns, mapq and the columns of tags ds qS qE vS vE qi).

    All places are those of the forward read and contig.
    """
    fields = ["qname", "qlen", "qb", "qe", F.when(F.col("strand") == 1, "-").otherwise("+"), "sname", "sl", "sb", "se", "matches", "columns", "mapq"]
    cols = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return frags.select(F.concat_ws("\t", *cols, *_tags(["ds", "qS", "qE", "vS", "vE", "qi"])).alias("value"))


def parse_paf(lines: DataFrame) -> DataFrame:
    p = F.split("value", "\t")
    names = ["qname", "qlen", "qb", "qe", "strand", "sname", "sl", "sb", "se", "matches", "columns", "mapq"]
    return lines.select(*[(F.element_at(p, k + 1) if n in ("qname", "strand", "sname") else F.element_at(p, k + 1).cast("long")).alias(n) for k, n in enumerate(names)])


def sam_lines(frags: DataFrame, fragments: bool = False) -> DataFrame:
    """SAM records of fragments with qname, flag, sname, sb, mapq, cigar, seq, qual and TAG_COLUMNS; fragments: one record each, no clips."""
    flag = F.col("flag").bitwiseAND(16) if fragments else F.col("flag")
    cols = ["qname", flag, "sname", F.col("sb") + 1, "mapq", "cigar", F.lit("*"), F.lit(0), F.lit(0), "seq", "qual"]
    return frags.select(F.concat_ws("\t", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols], *_tags(TAGS)).alias("value"))


def fasta_lines(seqs: DataFrame) -> DataFrame:
    return seqs.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value"))


def fastq_lines(reads: DataFrame) -> DataFrame:
    return reads.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))


def parse_truth(headers: DataFrame) -> DataFrame:
    """(read_id, ord, chr, sb, se) from headers '<read> <name> chr-from-to-...;...'."""
    third = F.element_at(F.split("header", " "), 3)
    rows = headers.select("read_id", F.posexplode(F.filter(F.split(third, ";"), lambda x: x != "")).alias("ord", "t"))
    part = lambda k: F.regexp_extract("t", r"^([^-]*)-(\d+)-(\d+)", k)
    return rows.select("read_id", "ord", part(1).alias("chr"), part(2).cast("long").alias("sb"), part(3).cast("long").alias("se"))


def truth_stats(truth: DataFrame) -> DataFrame:
    """One row: reads, frags, bases, contacts, and whole means."""
    g = truth.groupBy("read_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("se - sb")).alias("bases"))
    row = g.agg(F.count(F.lit(1)).alias("reads"), F.sum("n").alias("frags"), F.sum("bases").alias("bases"), F.sum(F.expr("n * (n - 1) div 2")).alias("contacts"))
    return row.select("*", F.expr("frags div reads").alias("mean_frags"), F.expr("bases div reads").alias("mean_bases"))
