"""Queries over candidates, depth, enzyme evidence and read tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catena.functions import dna
from catena.operators import candidates as ca
from catena.operators import fragments as fr
from catena.operators import index as ix
from catena.operators import inference as inf
from catena.operators import sites as st
from catena.plans.queries import _C, _CIGAR, _CUT, _F, _K, _O, _SITES, _SPAN, ORDER, _cigars, document_contigs, line_fragments, passage_reads, query, read


@query(f"""WITH {_C}, a0 AS (SELECT sid, seq, unnest(range(0, length(seq) - 14)) AS p FROM c), a AS (SELECT sid, p, substr(seq, CAST(p + 1 AS BIGINT), 15) AS k FROM a0),
h AS (SELECT q.sid, q.p AS qoff, s.p AS soff FROM a q JOIN a s ON q.sid = s.sid AND q.k = s.k),
g AS (SELECT * FROM h QUALIFY count(*) OVER (PARTITION BY sid, soff) <= 20)
SELECT sid, count(*) AS seeds, CAST(sum(abs(qoff - soff)) AS BIGINT) AS apart FROM g GROUP BY sid""")
def local_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = document_contigs(spark, sf_dir).select(F.col("sid").alias("id"), F.col("seq").alias("q"), F.col("seq").alias("s"))
    got = ca.local_seeds(pairs)
    return got.groupBy(F.col("id").alias("sid")).agg(F.count(F.lit(1)).alias("seeds"), F.sum(F.abs(F.col("qoff") - F.col("soff")).cast("long")).alias("apart"))


@query(f"""WITH {_F}, x AS (SELECT read_id, sb AS p, 1 AS d FROM f UNION ALL SELECT read_id, se, -1 FROM f), s AS (SELECT read_id, p AS b, sum(d) AS d FROM x GROUP BY ALL),
w AS (SELECT read_id, b, lead(b) OVER v AS e, least(sum(d) OVER v, 100) AS depth FROM s WINDOW v AS (PARTITION BY read_id ORDER BY b))
SELECT read_id, count(*) AS parts, CAST(max(depth) AS BIGINT) AS deepest, CAST(sum((e - b) * depth) AS BIGINT) AS bases FROM w WHERE e IS NOT NULL AND depth > 0 GROUP BY read_id""")
def coverage_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ca.depth(line_fragments(spark, sf_dir).select("read_id", F.col("sb").alias("b"), F.col("se").alias("e")))
    return got.groupBy("read_id").agg(F.count(F.lit(1)).alias("parts"), F.max(F.col("depth").cast("long")).alias("deepest"), F.sum((F.col("e") - F.col("b")) * F.col("depth")).alias("bases"))


@query()
def capped_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("read_id").orderBy(*ORDER)).cast("long")
    hits = line_fragments(spark, sf_dir).select("read_id", rank.alias("hit"), F.col("sb").alias("b"), F.col("se").alias("e"), "score")
    return ca.capped_hits(hits).select("read_id", "hit", "kept")


_ENDS = """hit AS (SELECT sid, CAST(len // 3 AS BIGINT) AS qoff, CAST(len // 3 + 7 AS BIGINT) AS soff, CAST(least(len, len // 3 + 400) AS BIGINT) AS qend, CAST(least(len, len // 3 + 410) AS BIGINT) AS send FROM c),
a AS (SELECT sid, list(pos) AS ps FROM s GROUP BY sid),
st AS (SELECT h.*, ps, unnest(list_filter(ps, lambda x: abs(x - qoff) <= 50)) AS qb FROM hit h JOIN a USING (sid)),
s2 AS (SELECT *, unnest(list_filter(ps, lambda x: abs(x - soff) <= 50)) AS sb FROM st),
s3 AS (SELECT *, unnest(list_filter(ps, lambda x: abs(x - qend) <= 50 AND x - qb >= 20)) AS qe FROM s2),
s4 AS (SELECT *, unnest(list_filter(ps, lambda x: abs(x - send) <= 50 AND x - sb >= 20)) AS se FROM s3)"""


@query(f"""WITH {_C}, {_SITES}, {_ENDS}
SELECT sid, CAST(qb AS BIGINT) AS qb, CAST(qe AS BIGINT) AS qe, CAST(sb AS BIGINT) AS sb, CAST(se AS BIGINT) AS se FROM s4
QUALIFY row_number() OVER (PARTITION BY sid, qoff, soff, qb, sb ORDER BY abs(qe - qend) + abs(se - send), qe, se) = 1""")
def site_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = document_contigs(spark, sf_dir)
    at = F.expr("len div 3")
    hits = refs.select(F.col("sid").alias("id"), at.alias("qoff"), F.least("len", at + 400).alias("qend"), (at + 7).alias("soff"), F.least("len", at + 410).alias("send"), dna.site_array(F.col("seq"), "GATC").alias("sites"))
    got = ca.site_candidates(hits, F.col("sites"), F.col("sites"))
    return got.select(F.col("id").alias("sid"), *[F.col(c).cast("long").alias(c) for c in ("qb", "qe", "sb", "se")])


@query(f"""WITH {_F}, w AS (SELECT *, lag(sid) OVER v AS ps, lag(strand) OVER v AS pt, lag(sb) OVER v AS pb, lag(se) OVER v AS pe FROM f WINDOW v AS (PARTITION BY read_id ORDER BY {_O}))
SELECT read_id, count(ps) AS neighbours, count(*) FILTER (sb - pe < 0) AS overlaps, CAST(sum(sb - pe) AS BIGINT) AS gaps, count(*) FILTER (sid = ps AND strand = pt AND sb > pb AND se > pe) AS colinear FROM w GROUP BY read_id""")
def adjacent_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = line_fragments(spark, sf_dir).withColumn("b", F.col("sb")).withColumn("e", F.col("se"))
    got = ca.adjacent(f, ORDER)
    return got.groupBy("read_id").agg(F.count("gap").alias("neighbours"), F.count(F.when(F.col("gap") < 0, 1)).alias("overlaps"), F.sum("gap").alias("gaps"), F.count(F.when(F.col("colinear"), 1)).alias("colinear"))


_PAST = "rows BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query(f"""WITH {_F}, d AS (SELECT DISTINCT read_id, strand AS part, sb AS qoff, se AS soff FROM f),
w AS (SELECT *, coalesce(max(qoff) OVER v, -1) AS q, coalesce(max(soff) OVER v, -1) AS s FROM d WINDOW v AS (PARTITION BY read_id ORDER BY part, qoff, soff {_PAST}))
SELECT read_id, part, qoff, soff FROM w WHERE qoff > q AND soff > s""")
def merged_seed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_fragments(spark, sf_dir).select("read_id", F.col("strand").alias("part"), F.col("sb").alias("qoff"), F.col("se").alias("soff")).distinct()
    return ca.merged_seed_lists(d, ["read_id"])


@query(f"""WITH {_F}, l AS (SELECT read_id, strand, list(DISTINCT sid) AS s FROM f GROUP BY ALL)
SELECT a.read_id, list_has_all(b.s, a.s) AS inside FROM l a JOIN l b ON a.read_id = b.read_id AND a.strand = 0 AND b.strand = 1""")
def contig_sets_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = line_fragments(spark, sf_dir).groupBy("read_id", "strand").agg(F.collect_set("sid").alias("s"))
    a, b = (l.where(F.col("strand") == k).select("read_id", F.col("s").alias(n)) for k, n in ((0, "a"), (1, "b")))
    return a.join(b, "read_id").select("read_id", ca.subset_of(F.col("a"), F.col("b")).alias("inside"))


def _motif_sql(seq: str, at: str, motif: str) -> str:
    return f"instr(substr({seq}, CAST(greatest({at} - 30, 0) + 1 AS BIGINT), CAST({at} + 30 - greatest({at} - 30, 0) AS BIGINT)), '{motif}') > 0"


def _evidence_sql(motif: str) -> str:
    inside = " AND ".join(f"{c} >= 200 AND {c} <= len - 200" for c in ("qb", "qe", "sb", "se"))
    return inside + " AND " + " AND ".join(_motif_sql("seq", c, motif) for c in ("qb", "qe", "sb", "se"))


_MOTIFS = {e: dna.parse_enzyme(e)[0] for e in sorted(dna.ENZYMES)}


@query(f"""WITH {_C}, g AS (SELECT seq, len, len // 4 AS qb, len - len // 4 AS qe, len // 4 + 5 AS sb, len - len // 4 - 5 AS se FROM c WHERE len - 2 * (len // 4) >= 200 AND sid % 61 >= 10),
v AS ({" UNION ALL ".join(f"SELECT '{e}' AS enzyme, count(*) FILTER ({_evidence_sql(m)}) AS votes FROM g" for e, m in _MOTIFS.items())}),
w AS (SELECT *, row_number() OVER (ORDER BY votes DESC, enzyme) AS rn, coalesce(lead(votes) OVER (ORDER BY votes DESC, enzyme), 0) AS nxt FROM v)
SELECT enzyme, votes, rn = 1 AND votes > 2 * nxt AS winner FROM w""")
def enzyme_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.expr("len div 4")
    c = document_contigs(spark, sf_dir)
    frags = c.select(F.col("seq").alias("qseq"), F.col("seq").alias("sseq"), q.alias("qb"), (F.col("len") - q).alias("qe"), (q + 5).alias("sb"), (F.col("len") - q - 5).alias("se"), (F.col("sid") % 61).alias("mapq"))
    return inf.enzyme_votes(frags)


@query(f"WITH {_F}, n AS (SELECT read_id, count(*) AS frags FROM f GROUP BY read_id) SELECT frags, count(*) AS reads FROM n GROUP BY frags")
def order_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.order_histogram(line_fragments(spark, sf_dir))


@query(f"WITH {_F} SELECT strand, count(*) AS frags FROM f GROUP BY strand")
def strand_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.strand_histogram(line_fragments(spark, sf_dir))


@query(f"""WITH {_F}, p AS (SELECT read_id, max((se - sb < 200)::INT) AS s FROM f GROUP BY read_id)
SELECT read_id, s = 1 AS has_short FROM p ORDER BY s DESC, md5('7:' || read_id), read_id LIMIT 500""")
def read_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.read_subset(line_fragments(spark, sf_dir).select("read_id", F.col("sb").alias("b"), F.col("se").alias("e")), 500, seed=7)


_DIGEST = "d AS (SELECT s.sid, s.ord, s.pos AS b, lead(s.pos) OVER (PARTITION BY s.sid ORDER BY s.ord) AS e FROM s), g AS (SELECT sid, b + ord % 2 AS sb, e + (ord % 3) // 2 AS se, ord % 11 AS mapq FROM d WHERE e IS NOT NULL)"


@query(f"""WITH {_C}, {_SITES}, {_DIGEST}, x AS (SELECT sid, sb AS pos FROM g WHERE mapq >= 5 UNION ALL SELECT sid, se FROM g WHERE mapq >= 5), u AS (SELECT DISTINCT sid, pos FROM s)
SELECT (SELECT count(*) FROM g WHERE mapq >= 5) AS frags, count(u.pos) AS supported, count(u.pos) / count(*) AS fraction FROM x LEFT JOIN u ON u.sid = x.sid AND u.pos = x.pos""")
def site_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    sites = st.site_table(document_contigs(spark, sf_dir), "DpnII")
    e = F.lead("pos").over(Window.partitionBy("sid").orderBy("ord"))
    d = sites.withColumn("e", e).where("e is not null")
    frags = d.select("sid", (F.col("pos") + F.col("ord") % 2).alias("sb"), (F.col("e") + F.expr("(ord % 3) div 2")).cast("int").alias("se"), (F.col("ord") % 11).alias("mapq"))
    return fr.site_support(frags, sites)


@query("""WITH u AS (SELECT 0 AS file, item_id AS id, text FROM benchmark UNION ALL SELECT 1, conv_id * 1000 + turn, text FROM conversations)
SELECT row_number() OVER (ORDER BY file, id) - 1 AS read_id, CAST(file AS BIGINT) AS file, id FROM u""")
def reads_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    second = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return fr.union_numbered([first, second], ["id"]).select("read_id", F.col("file").cast("long").alias("file"), "id")


@query(f"WITH {_F}, r AS (SELECT 'r' || o_orderkey AS name, o_custkey AS n FROM orders WHERE o_orderkey % 3 <> 0) SELECT f.read_id, f.sid, f.sb, r.n AS read_len FROM f JOIN r ON r.name = 'r' || f.read_id")
def records_of_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = line_fragments(spark, sf_dir).select(F.concat(F.lit("r"), "read_id").alias("qname"), "sid", "sb")
    own = read(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.concat(F.lit("r"), "o_orderkey").alias("name"), F.col("o_orderkey").alias("read_id"), F.repeat(F.lit("A"), F.col("o_custkey").cast("int")).alias("seq"))
    return fr.of_reads(records, own).select("read_id", "sid", "sb", F.col("read_len").cast("long").alias("read_len"))


@query(f"WITH {_K}, {_CUT} SELECT CAST(sum(n.n) AS BIGINT) AS removed, count(*) AS removed_distinct, CAST(max(n.n) AS BIGINT) AS most FROM n JOIN cut USING (bucket) WHERE n.n > cutoff")
def kmer_index_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = ix.repeats(ix.kmers(document_contigs(spark, sf_dir), "sid", step=ix.STEP))
    return gone.agg(F.sum("count").alias("removed"), F.count(F.lit(1)).alias("removed_distinct"), F.max("count").alias("most"))


_GAPS = "coalesce(list_sum(list_filter(list_transform(regexp_extract_all(g, '(\\d+)[ID]', 1), lambda x: x::BIGINT), lambda x: x > {n})), 0)"


@query(f"""WITH {_F}, c AS (SELECT DISTINCT {_CIGAR} AS g FROM f), e AS (SELECT g, {_SPAN('=')} AS m, {_SPAN('=XID')} - {_GAPS.format(n=7)} AS a, {_SPAN('=XID')} - {_GAPS.format(n=19)} AS b FROM c)
SELECT g AS cigar, CASE WHEN a < 50 THEN 0 ELSE 100.0::DOUBLE * m / a END AS short_gaps, CASE WHEN b < 1 THEN 0 ELSE 100.0::DOUBLE * m / b END AS long_gaps FROM e""")
def effective_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("cigar")
    return _cigars(spark, sf_dir).select("cigar").distinct().select("cigar", dna.effective_identity(g).alias("short_gaps"), dna.effective_identity(g, 19, 1).alias("long_gaps"))


@query()
def gapped_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each passage against itself, a made-up CIGAR that takes half of it, leaves out three bases on either side and takes the rest."""
    r = passage_reads(spark, sf_dir).where("length(seq) >= 20")
    half = F.expr("length(seq) div 2")
    cigar = F.concat(F.lit("2S"), (half - 2).cast("string"), F.lit("=3I3D"), (F.length("seq") - half - 3).cast("string"), F.lit("="))
    return r.select("read_id", dna.gapped(cigar, F.substring("seq", F.lit(3), F.length("seq")), F.substring("seq", F.lit(3), F.length("seq"))).alias("x")).select("read_id", "x.query", "x.subject")
