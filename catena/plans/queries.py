"""One query for each relational operator, bound to the driver's tables, and its SQL for DuckDB.

documents are contigs by a fold of text to DNA, benchmark passages are reads,
lineitem is a fragment table (order as read, supplier as contig).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catena.functions import dna
from catena.operators import fragments as fr
from catena.operators import index as ix
from catena.operators import sites as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.contigs(read(spark, sf_dir, "documents"), "doc_id", "source", dna.fold_text(F.col("text")))


def passage_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("read_id"), dna.fold_text(F.col("text")).alias("seq"))


def line_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments: sb and se from part and price, mapq from quantity, strand from the line number."""
    price = F.floor("l_extendedprice").cast("long")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("read_id"), F.col("l_suppkey").alias("sid"), F.floor("l_quantity").cast("long").alias("mapq"), F.col("l_partkey").alias("sb"),
        (F.col("l_partkey") + 100 + price % 1900).alias("se"), price.alias("score"), (F.col("l_linenumber") % 2).cast("long").alias("strand"), F.floor(F.col("l_discount") * 100).cast("long").alias("ds"),
    )


#: A total order of line_fragments but for equal rows.
ORDER = ["sb", "se", "sid", "mapq", "score", "strand", "ds"]
_O = ", ".join(ORDER)
_C = f"c AS (SELECT doc_id AS sid, source AS name, length({dna.fold_sql('text')}) AS len, {dna.fold_sql('text')} AS seq FROM documents WHERE length({dna.fold_sql('text')}) > 0)"
_B = f"b AS (SELECT item_id AS read_id, {dna.fold_sql('text')} AS seq FROM benchmark)"
_F = """f AS (SELECT l_orderkey AS read_id, l_suppkey AS sid, CAST(floor(l_quantity) AS BIGINT) AS mapq, l_partkey AS sb,
  l_partkey + 100 + CAST(floor(l_extendedprice) AS BIGINT) % 1900 AS se, CAST(floor(l_extendedprice) AS BIGINT) AS score,
  CAST(l_linenumber % 2 AS BIGINT) AS strand, CAST(floor(l_discount * 100) AS BIGINT) AS ds FROM lineitem)"""


def _kmer_sql(name: str, source: str, key: str, step: int, k: int = ix.K) -> str:
    return f"""{name}0 AS (SELECT {key}, unnest(range(0, length(seq) - {k - 1}, {step})) AS pos, seq FROM {source}),
{name}1 AS (SELECT {key}, pos, substr(seq, CAST(pos + 1 AS BIGINT), {k}) AS f FROM {name}0),
{name}2 AS (SELECT *, reverse(translate(f, 'ACGT', 'TGCA')) AS r FROM {name}1),
{name} AS (SELECT {key}, pos, least(f, r) AS kmer, f > r AS rev FROM {name}2 WHERE f <> r)"""


_K = f"{_C}, {_kmer_sql('k', 'c', 'sid', ix.STEP)}"
_CUT = f"""n AS (SELECT kmer, substr(kmer, 1, 2) AS bucket, count(*) AS n FROM k GROUP BY kmer),
o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC) AS rn, count(*) OVER (PARTITION BY bucket) AS d FROM n),
cut AS (SELECT bucket, d AS distinct_kmers, greatest(100, n) AS cutoff FROM o WHERE rn = floor(d * 0.0003) + 1)"""
_SITES = "s0 AS (SELECT sid, seq, len, unnest(range(1, greatest(len - 3, 1))) AS p FROM c), s1 AS (SELECT sid, p AS pos FROM s0 WHERE substr(seq, CAST(p + 1 AS BIGINT), 4) = 'GATC' UNION ALL SELECT sid, 0 FROM c UNION ALL SELECT sid, len FROM c UNION ALL SELECT sid, len + 1 FROM c), s AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY pos) - 1 AS ord, pos FROM s1)"


def _stats_sql(source: str) -> str:
    at = lambda q: f"(SELECT v FROM r WHERE rn = floor((SELECT count(*) FROM r) * {q}) + 1)"
    return f"""r AS (SELECT len AS v, row_number() OVER (ORDER BY len) AS rn FROM {source})
SELECT count(*) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(min(v) AS BIGINT) AS min, CAST(max(v) AS BIGINT) AS max, CAST({at(0.5)} AS BIGINT) AS median,
CAST({at(0.25)} AS BIGINT) AS n25, CAST({at(0.5)} AS BIGINT) AS n50, CAST({at(0.75)} AS BIGINT) AS n75, CAST(sum(v) // count(*) AS BIGINT) AS mean FROM r"""


@query(f"WITH {_C}, {_stats_sql('c')}")
def contig_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.length_stats(document_contigs(spark, sf_dir))


@query(f"WITH {_C} SELECT sid, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS reverse_md5, true AS back, md5(translate(seq, 'ACGT', '0123')) AS codes FROM c")
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rc = dna.reverse_complement
    return document_contigs(spark, sf_dir).select("sid", F.md5(rc(F.col("seq"))).alias("reverse_md5"), (rc(rc(F.col("seq"))) == F.col("seq")).alias("back"), F.md5(dna.encode(F.col("seq"))).alias("codes"))


@query(f"WITH {_K} SELECT count(*) AS kmers, count(DISTINCT kmer) AS distinct_kmers, count(*) FILTER (rev) AS reversed FROM k")
def kmer_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ix.kmers(document_contigs(spark, sf_dir), "sid", step=ix.STEP).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rev").cast("long")).alias("r"))
    return by.agg(F.sum("n").alias("kmers"), F.count(F.lit(1)).alias("distinct_kmers"), F.sum("r").alias("reversed"))


@query(f"WITH {_K}, {_CUT} SELECT bucket, distinct_kmers, cutoff FROM cut")
def kmer_bucket_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.bucket_cutoffs(ix.kmers(document_contigs(spark, sf_dir), "sid", step=ix.STEP))


@query(f"WITH {_K}, {_CUT} SELECT n.bucket, CAST(sum(n.n) AS BIGINT) AS kept, count(*) AS kept_distinct FROM n JOIN cut USING (bucket) WHERE n.n <= cutoff GROUP BY n.bucket")
def kmer_index_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ix.build_index(document_contigs(spark, sf_dir)).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy(ix.bucket(F.col("kmer")).alias("bucket")).agg(F.sum("n").alias("kept"), F.count(F.lit(1)).alias("kept_distinct"))


_SEEDS = f"""{_K}, {_CUT}, keep AS (SELECT k.* FROM k JOIN n USING (kmer) JOIN cut USING (bucket) WHERE n.n <= cutoff),
{_B}, {_kmer_sql('q', 'b', 'read_id', 1)},
h AS (SELECT q.read_id, keep.sid, CASE WHEN q.rev = keep.rev THEN 0 ELSE 1 END AS strand, keep.pos + 14 AS soff,
  CASE WHEN q.rev = keep.rev THEN q.pos + 14 ELSE length(b.seq) - 1 - q.pos END AS qoff
  FROM q JOIN keep USING (kmer) JOIN b ON b.read_id = q.read_id),
seeds AS (SELECT * FROM h QUALIFY count(*) OVER (PARTITION BY read_id, sid, strand, soff) <= 10)"""


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.seeds(passage_reads(spark, sf_dir), ix.build_index(document_contigs(spark, sf_dir)))


@query(f"WITH {_SEEDS} SELECT read_id, sid, strand, count(*) AS n, CAST(min(soff) AS BIGINT) AS first_s, CAST(max(soff) AS BIGINT) AS last_s, CAST(sum(qoff) AS BIGINT) AS sum_q FROM seeds GROUP BY ALL")
def seed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("soff").cast("long")
    return _seeds(spark, sf_dir).groupBy("read_id", "sid", "strand").agg(F.count(F.lit(1)).alias("n"), F.min(s).alias("first_s"), F.max(s).alias("last_s"), F.sum("qoff").alias("sum_q"))


@query(f"WITH {_SEEDS}, g AS (SELECT read_id, sid, strand, count(*) AS n FROM seeds GROUP BY ALL) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY n DESC, sid, strand) = 1")
def best_contig_per_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _seeds(spark, sf_dir).groupBy("read_id", "sid", "strand").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(F.struct("sid", "strand", "n"), F.struct(F.col("n"), -F.col("sid"), -F.col("strand")))
    return g.groupBy("read_id").agg(best.alias("x")).select("read_id", "x.sid", "x.strand", "x.n")


@query("WITH " + _C + ", e AS (SELECT unnest([{'e':'DpnII','m':'GATC'},{'e':'HindIII','m':'AAGCTT'},{'e':'NcoI','m':'CCATGG'},{'e':'NlaIII','m':'CATG'}], recursive := true)), p AS (SELECT sid, e, m, seq, unnest(range(1, greatest(len - length(m) + 1, 1))) AS p FROM c, e) SELECT e AS enzyme, count(*) AS sites, CAST(sum(p) AS BIGINT) AS sum_pos FROM p WHERE substr(seq, CAST(p + 1 AS BIGINT), length(m)) = m GROUP BY e")
def site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = document_contigs(spark, sf_dir)
    arrays = refs.select(F.explode(F.array(*[F.struct(F.lit(e).alias("enzyme"), dna.site_array(F.col("seq"), dna.parse_enzyme(e)[0]).alias("s")) for e in dna.ENZYMES])).alias("x"))
    inner = F.slice("x.s", 2, F.size("x.s") - 3)
    return arrays.groupBy("x.enzyme").agg(F.sum(F.size(inner)).alias("sites"), F.sum(F.aggregate(inner, F.lit(0).cast("long"), lambda a, p: a + p)).alias("sum_pos")).where("sites > 0")


@query(f"WITH {_C}, {_SITES} SELECT sid, CAST(ord AS BIGINT) AS ord, CAST(pos AS BIGINT) AS pos FROM s")
def site_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.site_table(document_contigs(spark, sf_dir), "DpnII").select("sid", F.col("ord").cast("long").alias("ord"), F.col("pos").cast("long").alias("pos"))


@query(f"WITH {_C}, {_SITES}, d AS (SELECT s.sid, s.pos AS b, lead(s.pos) OVER (PARTITION BY s.sid ORDER BY s.ord) AS e, c.len FROM s JOIN c USING (sid)) SELECT sid, count(*) AS fragments, CAST(max(e - b) AS BIGINT) AS longest, CAST(sum(e - b) AS BIGINT) AS total FROM d WHERE e <= len GROUP BY sid")
def fragment_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.digest(document_contigs(spark, sf_dir), "DpnII").groupBy("sid").agg(F.count(F.lit(1)).alias("fragments"), F.max(F.expr("cast(e - b as bigint)")).alias("longest"), F.sum(F.expr("e - b")).alias("total"))


@query(f"""WITH {_C}, {_SITES}, p AS (SELECT sid, len, unnest(range(7, len, 97)) AS pos FROM c),
l AS (SELECT p.sid, p.pos, s.pos AS l, s.ord FROM p ASOF JOIN s ON p.sid = s.sid AND p.pos >= s.pos)
SELECT l.sid, CAST(l.pos AS BIGINT) AS pos, CAST(CASE WHEN l.pos - l.l <= r.pos - l.pos THEN l.l ELSE r.pos END AS BIGINT) AS site FROM l JOIN s r ON r.sid = l.sid AND r.ord = l.ord + 1""")
def nearest_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = document_contigs(spark, sf_dir)
    points = refs.where("len > 7").select("sid", F.explode(F.sequence(F.lit(7), F.col("len") - 1, F.lit(97))).alias("pos"))
    got = st.nearest_site(points, st.site_arrays(refs, "DpnII"))
    return got.select("sid", F.col("pos").cast("long").alias("pos"), F.col("site").cast("long").alias("site"))


_HITS = "hit AS (SELECT sid, len, CAST(len // 3 AS BIGINT) AS qoff, CAST(len // 3 + 7 AS BIGINT) AS soff, CAST(least(len, len // 3 + 400) AS BIGINT) AS qend, CAST(least(len, len // 3 + 410) AS BIGINT) AS send FROM c)"


@query(f"""WITH {_C}, {_SITES}, {_HITS}, a AS (SELECT sid, list(pos) AS ps FROM s GROUP BY sid),
q AS (SELECT h.*, ps, unnest(list_filter(ps, lambda x: abs(x - qoff) <= 50 AND x <= qend - 1)) AS qsite FROM hit h JOIN a USING (sid)),
t AS (SELECT *, unnest(list_filter(ps, lambda x: abs(x - soff) <= 50 AND x <= send - 1)) AS ssite FROM q)
SELECT sid, CAST(qsite AS BIGINT) AS qsite, CAST(ssite AS BIGINT) AS ssite FROM t
WHERE abs((qend - qsite) - (send - ssite)) <= 50 AND abs(1 - (qend - qsite) / (send - ssite)) <= 0.25""")
def nearby_site_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = document_contigs(spark, sf_dir)
    at = F.expr("len div 3")
    hits = refs.select("sid", at.alias("qoff"), (at + 7).alias("soff"), F.least("len", at + 400).alias("qend"), F.least("len", at + 410).alias("send")).join(st.site_arrays(refs, "DpnII"), "sid")
    got = st.nearby_pairs(hits, F.col("sites"), F.col("sites"))
    return got.select("sid", F.col("pair.qsite").cast("long").alias("qsite"), F.col("pair.ssite").cast("long").alias("ssite"))


_N = f"{_F}, m AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY {_O}) - 1 AS frag_id FROM f)"


@query(f"WITH {_N} SELECT a.sid, count(*) AS contacts, CAST(sum(b.frag_id - a.frag_id) AS BIGINT) AS distance FROM m a JOIN m b ON a.read_id = b.read_id AND a.sid = b.sid AND a.frag_id < b.frag_id WHERE b.mapq >= 5 GROUP BY a.sid")
def contact_pairs_by_contig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.contact_pairs(line_fragments(spark, sf_dir), ORDER).groupBy("sid").agg(F.count(F.lit(1)).alias("contacts"), F.sum(F.expr("b - a")).cast("long").alias("distance"))


@query(f"""WITH {_N}, p AS (SELECT a.mapq >= 5 AS both_ FROM m a JOIN m b ON a.read_id = b.read_id AND a.sid = b.sid AND a.frag_id < b.frag_id WHERE b.mapq >= 5)
SELECT (SELECT count(DISTINCT read_id) FROM f) AS reads, (SELECT count(*) FROM f WHERE mapq >= 5) AS frags, (SELECT count(*) FROM p) AS contacts, (SELECT count(*) FROM p WHERE both_) AS strict_contacts""")
def contact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.contact_counts(line_fragments(spark, sf_dir), ORDER)


@query(f"WITH {_F} SELECT count(*) AS frags, CAST(sum((sb % 7 = 0)::BIGINT + (se % 5 = 0)::BIGINT) AS BIGINT) AS supported, sum((sb % 7 = 0)::BIGINT + (se % 5 = 0)::BIGINT) / (2 * count(*)) AS fraction FROM f WHERE mapq >= 5")
def fragment_end_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.end_support(line_fragments(spark, sf_dir), F.col("sb") % 7 == 0, F.col("se") % 5 == 0)


@query(f"WITH {_C}, w AS (SELECT sid, len, coalesce(sum(len) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY sid) AS rn FROM c) SELECT sid, CAST(len AS BIGINT) AS len FROM w WHERE before < 1000000 AND rn <= 400")
def prefix_limit_by_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.prefix_by_sum(document_contigs(spark, sf_dir).select("sid", F.col("len").cast("long").alias("len")), ["sid"], "len", dna.parse_size("1m"), 400)


@query(f"WITH {_N} SELECT read_id, frag_id, sid, sb, se, lpad(read_id::VARCHAR, 10, '0') || ':' || lpad(frag_id::VARCHAR, 10, '0') || ':' || lpad(sid::VARCHAR, 10, '0') || ':' || lpad(sb::VARCHAR, 10, '0') AS fragment FROM m")
def frag_rank_and_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fr.numbered(line_fragments(spark, sf_dir), ORDER).withColumn("frag_id", F.col("frag_id").cast("long"))
    return f.select("read_id", "frag_id", "sid", "sb", "se", dna.fragment_id(F.col("read_id"), F.col("frag_id"), F.col("sid"), F.col("sb")).alias("fragment"))


@query(f"WITH {_F}, p AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY score DESC, {_O}) AS rn FROM f) SELECT CAST(strand * 16 + CASE WHEN rn = 1 AND score > 0 THEN 0 ELSE 2048 END AS BIGINT) AS flag, count(*) AS n, CAST(sum(score) AS BIGINT) AS score FROM p GROUP BY 1")
def primary_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.sam_flags(line_fragments(spark, sf_dir), ORDER).groupBy(F.col("flag").cast("long").alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))


@query(f"WITH {_F}, g AS (SELECT (se - sb) // 100 AS bin, count(*) AS n, avg(ds) AS mean_score FROM f WHERE mapq >= 5 AND se - sb < 2000 GROUP BY 1) SELECT CAST(r.i * 100 + 50 AS BIGINT) AS centre, coalesce(n, 0) AS n, mean_score FROM range(20) r(i) LEFT JOIN g ON g.bin = r.i")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.histogram(line_fragments(spark, sf_dir), F.col("se") - F.col("sb"), F.col("ds"))


_HEADER = "h AS (SELECT read_id, 'sim' || read_id || ' p0_' || min(sid) || '_' || read_id || ' ' || string_agg(sid || '-' || sb || '-' || se || '-' || strand || '-0', ';' ORDER BY sb, se, sid, strand) AS header FROM f GROUP BY read_id)"


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("sb", "se", "sid", "strand"))), lambda x: F.concat_ws("-", x["sid"], x["sb"], x["se"], x["strand"], F.lit(0)))
    g = line_fragments(spark, sf_dir).groupBy("read_id").agg(F.concat_ws(";", parts).alias("frags"), F.min("sid").alias("sid"))
    return g.select("read_id", F.concat(F.lit("sim"), "read_id", F.lit(" p0_"), "sid", F.lit("_"), "read_id", F.lit(" "), "frags").alias("header"))


@query(f"WITH {_F}, {_HEADER}, x AS (SELECT read_id, unnest(string_split(string_split(header, ' ')[3], ';')) AS t FROM h) SELECT read_id, CAST(string_split(t, '-')[1] AS BIGINT) AS sid, CAST(string_split(t, '-')[2] AS BIGINT) AS sb, CAST(string_split(t, '-')[3] AS BIGINT) AS se FROM x")
def truth_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catena.sources.text import parse_truth

    return parse_truth(_headers(spark, sf_dir)).select("read_id", F.col("chr").cast("long").alias("sid"), "sb", "se")


@query(f"WITH {_F}, g AS (SELECT read_id, count(*) AS n, sum(se - sb) AS bases FROM f GROUP BY read_id) SELECT count(*) AS reads, CAST(sum(n) AS BIGINT) AS frags, CAST(sum(bases) AS BIGINT) AS bases, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS contacts, CAST(sum(n) // count(*) AS BIGINT) AS mean_frags, CAST(sum(bases) // count(*) AS BIGINT) AS mean_bases FROM g")
def sim_fastq_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catena.sources.text import parse_truth, truth_stats

    return truth_stats(parse_truth(_headers(spark, sf_dir)))


_T = f"{_N}, t AS (SELECT read_id, sid, sb + frag_id % 9 AS sb, se + (score % 5) * 100 AS se, frag_id AS ord FROM m WHERE score % 4 <> 0), q AS (SELECT read_id, sid, sb, se, row_number() OVER (PARTITION BY read_id ORDER BY {_O}) - 1 AS frag_id FROM f WHERE mapq >= 5)"


@query(f"""WITH {_T}, hit AS (SELECT q.read_id, q.frag_id, (abs(q.sb - t.sb) <= 4)::BIGINT + (abs(q.se - t.se) <= 4)::BIGINT AS ends, row_number() OVER (PARTITION BY q.read_id, q.frag_id ORDER BY t.ord) AS rn
  FROM q JOIN t ON q.read_id = t.read_id AND q.sid = t.sid WHERE least(q.se, t.se) - greatest(q.sb, t.sb) >= 0.8 * (q.se - q.sb) AND least(q.se, t.se) - greatest(q.sb, t.sb) >= 0.8 * (t.se - t.sb) AND least(q.se, t.se) > greatest(q.sb, t.sb)),
k AS (SELECT q.read_id, count(*) AS n, count(hit.ends) AS k, sum(hit.ends) AS e FROM q LEFT JOIN hit ON hit.read_id = q.read_id AND hit.frag_id = q.frag_id AND hit.rn = 1 GROUP BY q.read_id),
a AS (SELECT CAST(sum(n) AS BIGINT) AS n_called, CAST(sum(k) AS BIGINT) AS n_right, sum(e) AS ends, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS called_pairs, CAST(sum(k * (k - 1) // 2) AS BIGINT) AS right_pairs FROM k),
u AS (SELECT CAST(sum(n) AS BIGINT) AS n_true, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS true_pairs FROM (SELECT count(*) AS n FROM t GROUP BY read_id))
SELECT n_true, n_called, n_right, n_right / n_called AS precision, n_right / n_true AS recall, ends / (2 * n_right) AS boundary_precision, true_pairs, called_pairs, right_pairs, right_pairs / called_pairs AS contact_precision, right_pairs / true_pairs AS contact_recall FROM a, u""")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = line_fragments(spark, sf_dir)
    truth = fr.numbered(f, ORDER).where("score % 4 <> 0").select("read_id", "sid", F.expr("sb + frag_id % 9").alias("sb"), F.expr("se + (score % 5) * 100").alias("se"), F.col("frag_id").alias("ord"))
    return fr.evaluate(f, truth, ORDER)


@query(f"""WITH {_F}, h AS (SELECT read_id, sb AS b, se AS e, row_number() OVER (PARTITION BY read_id ORDER BY score DESC, {_O}) AS rank FROM f),
p AS (SELECT h.read_id, h.rank, o.rank AS p, least(h.e, o.e) - greatest(h.b, o.b) AS ov FROM h JOIN h o ON h.read_id = o.read_id AND o.rank < h.rank WHERE least(h.e, o.e) - greatest(h.b, o.b) >= 0.8 * (h.e - h.b) AND least(h.e, o.e) > greatest(h.b, o.b)),
x AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY read_id, rank ORDER BY ov DESC, p DESC) = 1)
SELECT h.read_id, CAST(h.rank AS BIGINT) AS rank, CAST(x.p AS BIGINT) AS parent FROM h LEFT JOIN x ON x.read_id = h.read_id AND x.rank = h.rank""")
def parent_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("read_id").orderBy(F.desc("score"), *ORDER))
    hits = line_fragments(spark, sf_dir).select("read_id", F.col("sb").alias("b"), F.col("se").alias("e"), rank.cast("long").alias("rank"))
    return fr.parents(hits).select("read_id", "rank", "parent")


@query(f"WITH {_F}, n AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY {_O}, read_id) - 1 AS r, count(*) OVER (PARTITION BY sid) AS n, se - sb AS len FROM f) SELECT sid, CAST(floor(r / ceil(n / 10.0)) AS BIGINT) AS chunk, count(*) AS n, CAST(sum(len) AS BIGINT) AS bases FROM n GROUP BY 1, 2")
def chunk_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fr.chunks(line_fragments(spark, sf_dir), [*ORDER, "read_id"])
    return f.groupBy("sid", F.col("chunk").cast("long").alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("se - sb")).alias("bases"))


_CIGAR = "(sb % 30) || 'S' || (sb % 90 + 8) || '=' || (score % 9 + 1) || 'X' || (score % 40 + 1) || 'I' || (se % 50 + 1) || '=' || (se % 12 + 1) || 'D' || (mapq + 1) || '=' || (ds % 5) || 'H'"
_SPAN = lambda ops: f"list_sum(list_transform(regexp_extract_all(g, '(\\d+)[{ops}]', 1), lambda x: x::BIGINT))"


def _cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda e: F.expr(f"cast({e} as string)")
    parts = [("sb % 30", "S"), ("sb % 90 + 8", "="), ("score % 9 + 1", "X"), ("score % 40 + 1", "I"), ("se % 50 + 1", "="), ("se % 12 + 1", "D"), ("mapq + 1", "="), ("ds % 5", "H")]
    return line_fragments(spark, sf_dir).withColumn("cigar", F.concat(*[c for e, op in parts for c in (n(e), F.lit(op))]))


@query(f"WITH {_F}, c AS (SELECT strand, {_CIGAR} AS g FROM f) SELECT g AS cigar, count(*) AS n, CAST({_SPAN('MDN=X')} AS BIGINT) AS subject, CAST({_SPAN('MI=X')} AS BIGINT) AS query, CAST({_SPAN('MI=XSHDNP')} AS BIGINT) AS total, CAST(CASE WHEN strand > 0 THEN regexp_extract(g, '(\\d+)[SH]$', 1) ELSE regexp_extract(g, '^(\\d+)[SH]', 1) END AS BIGINT) AS fwd_start FROM c GROUP BY g, strand")
def cigar_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, g = _cigars(spark, sf_dir).groupBy("cigar", "strand").agg(F.count(F.lit(1)).alias("n")), F.col("cigar")
    return c.select("cigar", "n", dna.cigar_span(g, "MDN=X").alias("subject"), dna.cigar_span(g, "MI=X").alias("query"), dna.cigar_span(g, "MI=XSHDNP").alias("total"), dna.forward_start(F.col("strand") * 16, g, F.lit(0)).cast("long").alias("fwd_start"))


@query(f"WITH {_F}, c AS (SELECT DISTINCT {_CIGAR} AS g FROM f) SELECT g AS cigar, CAST(2 * {_SPAN('=')} - 5 * {_SPAN('X')} - 4 * {_SPAN('ID')} AS BIGINT) AS score, 100.0::DOUBLE * {_SPAN('=')} / {_SPAN('=XID')} AS pi, 100.0::DOUBLE * {_SPAN('=')} / ({_SPAN('=XID')} - coalesce(list_sum(list_filter(list_transform(regexp_extract_all(g, '(\\d+)[ID]', 1), lambda x: x::BIGINT), lambda x: x > 8)), 0)) AS epi FROM c")
def cigar_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("cigar")
    return _cigars(spark, sf_dir).select("cigar").distinct().select("cigar", dna.cigar_score(g).alias("score"), dna.cigar_identity(g).alias("pi"), dna.cigar_identity(g, 8).alias("epi"))


@query(f"WITH {_F} SELECT count(*) FILTER (mapq * 2 - 10 BETWEEN 0 AND 60) AS kept, count(*) AS records, 1.0::DOUBLE - count(*) FILTER (mapq * 2 - 10 BETWEEN 0 AND 60) / count(*) AS dropped FROM f")
def sam_mapq_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.expr("mapq * 2 - 10")
    kept = F.sum(q.between(0, 60).cast("long"))
    return line_fragments(spark, sf_dir).agg(kept.alias("kept"), F.count(F.lit(1)).alias("records"), (1.0 - kept / F.count(F.lit(1))).alias("dropped"))


@query(f"WITH {_F} SELECT CAST(score % 512 AS BIGINT) AS flag, count(*) AS n FROM f WHERE (score % 512) & 260 = 0 GROUP BY 1")
def sam_flag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catena.sources.text import mapped_primary

    return mapped_primary(line_fragments(spark, sf_dir).withColumn("flag", F.col("score") % 512)).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("WITH v AS (SELECT enzyme, sites AS votes FROM (" + ORACLE_SQL["site_counts"] + ")), w AS (SELECT *, row_number() OVER (ORDER BY votes DESC, enzyme) AS rn, coalesce(lead(votes) OVER (ORDER BY votes DESC, enzyme), 0) AS nxt FROM v) SELECT enzyme, votes, rn = 1 AND votes > 2 * nxt AS winner FROM w")
def enzyme_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.vote(site_counts(spark, sf_dir).select("enzyme", F.col("sites").alias("votes")))


@query("WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT string_agg(source, ' ' ORDER BY source) AS names, count(*) AS n FROM c WHERE NOT regexp_matches(upper(source), 'UN|RANDOM|ALT')")
def contig_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "documents").select("source").distinct().where(~dna.unplaced(F.col("source")))
    return names.agg(F.concat_ws(" ", F.array_sort(F.collect_list("source"))).alias("names"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_C} SELECT sid, name, CAST(len AS BIGINT) AS len FROM c WHERE name IN ('src1', 'src3')")
def extract_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_contigs(spark, sf_dir).where(F.col("name").isin("src1", "src3")).select("sid", "name", F.col("len").cast("long").alias("len"))


_DAG = f"{_F}, d AS (SELECT DISTINCT read_id, sb % 4000 AS b, sb % 4000 + 60 + score % 700 AS e, score % 500 AS score FROM f), v AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY b, e, score) - 1 AS node FROM d)"


@query(f"""WITH RECURSIVE {_DAG}, p AS (
  SELECT read_id, node, b, e, CASE WHEN b = 0 THEN 0 ELSE 4 + 2 * b END - score AS cost FROM v
  UNION SELECT v.read_id, v.node, v.b, v.e, p.cost + CASE WHEN v.b = p.e THEN 0 ELSE 4 + 2 * abs(v.b - p.e) END - v.score
  FROM p JOIN v ON v.read_id = p.read_id AND v.b - p.b >= 50 AND v.e - p.e >= 50)
SELECT read_id, CAST(min(cost + CASE WHEN e = 5000 THEN 0 ELSE 4 + 2 * (5000 - e) END) AS BIGINT) AS cost FROM p GROUP BY read_id""")
def interval_cover_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    d = line_fragments(spark, sf_dir).select("read_id", F.expr("sb % 4000").alias("b"), F.expr("sb % 4000 + 60 + score % 700").alias("e"), F.expr("score % 500").alias("score")).distinct()
    v = d.withColumn("node", F.row_number().over(Window.partitionBy("read_id").orderBy("b", "e", "score")) - 1)
    return fr.cover_path(v, 5000).select("read_id", "cost")


@query()
def ddf_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catena.operators.mapper import chains

    return chains(_seeds(spark, sf_dir))


def _fragments_of_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catena.operators.mapper import fragments

    refs = document_contigs(spark, sf_dir)
    reads = passage_reads(spark, sf_dir)
    return fragments(reads, refs, ix.seeds(reads, ix.build_index(refs)))


@query()
def mapped_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fragments_of_passages(spark, sf_dir)


@query()
def paf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catena.sources.text import paf_lines

    f = _fragments_of_passages(spark, sf_dir)
    sites = st.site_arrays(document_contigs(spark, sf_dir), "DpnII").withColumnRenamed("sites", "s_sites")
    own = passage_reads(spark, sf_dir).select("read_id", dna.site_array(F.col("seq"), "GATC").alias("q_sites"))
    f = f.join(sites, "sid").join(own, "read_id")
    near = lambda array, pos: dna.nearest_in(F.col(array), F.col(pos))
    f = f.select("*", F.col("read_id").cast("string").alias("qname"), F.col("sid").cast("string").alias("sname"), near("q_sites", "qb").alias("q_left"), near("q_sites", "qe").alias("q_right"), near("s_sites", "sb").alias("s_left"), near("s_sites", "se").alias("s_right"))
    return paf_lines(f)
