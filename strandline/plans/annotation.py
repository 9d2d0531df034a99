"""Queries of annotation joins, record fields and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions.intervals import introns
from ..functions.sequence import quality_kmers
from ..functions.text import sound_read, trim_homopolymer
from ..operators import intervals, kmers, transcripts
from .adapters import EX, IV, PAIRS, SEQ, TX, exons, guides, iv, merged_exons, reads, sequences, table
from .registry import query


@query(f"""WITH {PAIRS} SELECT a_id, b_id, ovlen FROM pairs WHERE ovlen >= 0.5 * (a_end - a_start + 1) AND ovlen >= 0.5 * (b_end - b_start + 1)""")
def overlap_reciprocal(s, d):
    """Pairs that share at least half of either interval."""
    return intervals.overlap_share(intervals.overlap_join(reads(s, d), guides(s, d)), 0.5, both=True).select("a_id", "b_id", "ovlen")


@query(f"""WITH {PAIRS}, q AS (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY a_start, a_id) AS k FROM pairs)
  SELECT b_id AS id, string_agg(a_id::VARCHAR, ',' ORDER BY k) AS hits FROM q WHERE k <= 3 GROUP BY b_id""")
def annotate_limit(s, d):
    """The first three annotations of each guide: the limit is an option of the operator."""
    first = intervals.first_overlaps(guides(s, d), reads(s, d), "id", 3)
    return intervals.first_annotations(first, "a_id", "b_id", 3, "k").select(F.col("a_id").alias("id"), "hits")


@query(f"""WITH {PAIRS}, q AS (SELECT *, (b_strand = a_strand)::INT AS same FROM pairs), m AS (SELECT *, max(same) OVER (PARTITION BY a_id) AS ms
  FROM q), b AS (SELECT *, max(ovlen) OVER (PARTITION BY a_id) AS best FROM m WHERE same = ms) SELECT a_id, b_id, same, ovlen FROM b
  WHERE ovlen + 5 >= best""")
def overlap_ranked(s, d):
    """Best overlaps where a preference comes before the length."""
    g, same = guides(s, d), (F.col("a_strand") == F.col("b_strand")).cast("int")
    pairs = lambda r: intervals.with_ovlen(intervals.overlap_join(r, g)).withColumn("same", same)
    return intervals.best_pairs(reads(s, d), "id", pairs, prefer=("same",)).select("a_id", "b_id", "same", "ovlen")


@query(f"""WITH {IV}, e AS (SELECT contig, "start" // 1000000 AS l, "end" // 1000000 AS r, strand, nh, "end" - "start" AS ov FROM iv)
  SELECT contig, l, r, strand, count(*) AS nreads, sum(1.0::DOUBLE / nh) AS nreads_weighed, max(ov) AS support FROM e GROUP BY ALL""")
def junctions(s, d):
    """Reads behind each junction, weighed ones, and the longest support."""
    x = iv(s, d).select("contig", F.floor(F.col("start") / 1000000).alias("l"), F.floor(F.col("end") / 1000000).alias("r"), "strand", "nh",
        (F.col("end") - F.col("start")).alias("ov"))
    return x.groupBy("contig", "l", "r", "strand").agg(F.count("*").alias("nreads"), F.sum(1 / F.col("nh")).alias("nreads_weighed"), F.max("ov").alias("support"))


@query("""SELECT l_returnflag AS strand, l_quantity::BIGINT AS first_, l_linenumber AS step, count(*) AS read_count, min(l_orderkey) AS first_read
  FROM lineitem GROUP BY ALL""")
def read_collapse(s, d):
    """Alignments alike in strand and blocks become one with a count."""
    return table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("strand"), F.col("l_quantity").cast("long").alias("first_"),
        F.col("l_linenumber").alias("step")).agg(F.count("*").alias("read_count"), F.min("l_orderkey").alias("first_read"))


@query("""WITH t AS (SELECT l_orderkey AS gene, l_linenumber AS tx, l_quantity AS cov FROM lineitem), m AS (SELECT *,
  max(cov) OVER (PARTITION BY gene) AS top FROM t) SELECT gene, tx, cov FROM m WHERE cov >= 1 AND cov >= 0.5 * top""")
def isoform_fraction(s, d):
    """Isoforms with at least half of their gene's best coverage."""
    t = table(s, d, "lineitem").select(F.col("l_orderkey").alias("gene"), F.col("l_linenumber").alias("tx"), F.col("l_quantity").alias("cov"))
    return transcripts.expressed(t, "gene", "cov", share=0.5, least=1.0)


@query(f"""WITH {TX}, nx AS (SELECT *, lead("start") OVER (PARTITION BY tx ORDER BY "start") AS nxt, min("start") OVER (PARTITION BY tx) AS lo,
  max("end") OVER (PARTITION BY tx) AS hi FROM mx),
ch AS (SELECT tx, any_value(contig) AS contig, any_value(strand) AS strand, min(lo) AS lo, max(hi) AS hi, list([("end" + 1), (nxt - 1)]
  ORDER BY "start") FILTER (nxt IS NOT NULL) AS chain FROM nx GROUP BY tx)
SELECT contig, strand, min(lo) AS tx_start, max(hi) AS tx_end, count(*) AS n, min(tx) AS first_tx FROM ch WHERE chain IS NOT NULL GROUP BY contig, strand, chain""")
def merge_isoforms(s, d):
    """One transcript for each intron chain, with the widest ends."""
    tx = transcripts.assemble(merged_exons(s, d), "tx", ("contig", "strand"))
    return transcripts.merge_by_chain(tx, "tx").select("contig", "strand", F.col("start").alias("tx_start"), F.col("end").alias("tx_end"), "n", "first_tx")


@query(f"""WITH {EX}, w AS (SELECT *, max("end") OVER (PARTITION BY contig, strand
  ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ex), c AS (SELECT *,
  sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY contig, strand
  ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS locus FROM w) SELECT contig, strand, locus::BIGINT AS locus,
  min("start") AS locus_start, max("end") AS locus_end, count(DISTINCT tx) AS n_tx FROM c GROUP BY contig, strand, locus""")
def loci(s, d):
    """Loci of a strand with the number of their transcripts."""
    x = intervals.clusters(exons(s, d), 0, ("contig", "strand"), "locus")
    return x.groupBy("contig", "strand", "locus").agg(F.min("start").alias("locus_start"), F.max("end").alias("locus_end"), F.countDistinct("tx").alias("n_tx"))


@query(f"""WITH {TX}, nx AS (SELECT *, lead("start") OVER (PARTITION BY tx ORDER BY "start") AS nxt FROM mx),
  i AS (SELECT tx, contig, strand, "end" + 1 AS l, nxt - 1 AS r FROM nx WHERE nxt IS NOT NULL),
k AS (SELECT DISTINCT contig, strand, l, r FROM i WHERE tx % 2 = 0) SELECT i.tx, count(*) AS n, count(k.l) AS known,
  count(*) = count(k.l) AS all_known FROM i LEFT JOIN k USING (contig, strand, l, r) WHERE i.tx % 2 = 1 GROUP BY i.tx""")
def introns_known(s, d):
    """Whether all introns of a transcript are introns of the guides."""
    tx = transcripts.assemble(merged_exons(s, d), "tx", ("contig", "strand"))
    i = tx.select("tx", "contig", "strand", F.explode(introns(F.col("exons"))).alias("i")).select("tx", "contig", "strand", "i.*")
    at = ["contig", "strand", "start", "end"]
    known = i.filter("tx % 2 = 0").select(*at).distinct().withColumn("known", F.lit(1))
    x = i.filter("tx % 2 = 1").join(known, at, "left").groupBy("tx").agg(F.count("*").alias("n"), F.count("known").alias("known"))
    return x.withColumn("all_known", F.col("n") == F.col("known"))


# --- statistics ------------------------------------------------------------------------------

_QUAD = """t AS (SELECT c_nationkey AS nation, count(*) FILTER (c_mktsegment = 'BUILDING' AND c_acctbal > 4000) AS a,
  count(*) FILTER (c_mktsegment = 'BUILDING' AND c_acctbal <= 4000) AS b, count(*) FILTER (c_mktsegment <> 'BUILDING' AND c_acctbal > 4000) AS c,
  count(*) FILTER (c_mktsegment <> 'BUILDING' AND c_acctbal <= 4000) AS d FROM customer GROUP BY 1)"""
_CHANCE = "exp(lgamma(a+b+1) - lgamma({x}+1) - lgamma(a+b-{x}+1) + lgamma(c+d+1) - lgamma(a+c-{x}+1) - lgamma(c+d-a-c+{x}+1) - lgamma(a+b+c+d+1) + lgamma(a+c+1) + lgamma(b+d+1))"


@query(f"""WITH {_QUAD}, x AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM t),
  p AS (SELECT nation, a, x, {_CHANCE.format(x="x")} AS p, {_CHANCE.format(x="a")} AS here FROM x)
SELECT nation, round(sum(p) FILTER (x <= a), 6) AS p_left, round(sum(p) FILTER (x >= a), 6) AS p_right,
  round(sum(p) FILTER (p <= here * (1 + 1e-8)), 6) AS p_two FROM p GROUP BY nation""")
def fisher_test(s, d):
    c = table(s, d, "customer")
    yes, high = F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") > 4000
    t = c.groupBy(F.col("c_nationkey").alias("nation")).agg(*(F.count_if(x).alias(n) for n,
        x in (("a", yes & high), ("b", yes & ~high), ("c", ~yes & high), ("d", ~yes & ~high))))
    t = t.withColumn("t", stats.fisher_exact(*map(F.col, "abcd")))
    return t.select("nation", *(F.round(f"t.{x}", 6).alias(f"p_{x}") for x in ("left", "right", "two")))


@query("SELECT p_size, round(exp(p_size * ln(12.5) - 12.5 - lgamma(p_size + 1)), 8) AS term, count(*) AS n FROM part GROUP BY p_size")
def poisson_terms(s, d):
    n = table(s, d, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    return n.select("p_size", F.round(stats.poisson_term(F.lit(12.5), F.col("p_size")), 8).alias("term"), "n")


# --- reads -----------------------------------------------------------------------------------


@query("""WITH c AS (SELECT p_partkey AS id, p_name AS seq, unnest(range(1, length(p_name))) AS i FROM part), s AS (SELECT id, seq, i,
  sum(CASE WHEN substr(seq, length(seq) - i, 1) = substr(seq, length(seq) - i + 1, 1) THEN 1 ELSE -1 END) OVER (PARTITION BY id ORDER BY i) AS score
  FROM c),
b AS (SELECT id, arg_max(i, score * 1000 - i) AS cut, max(score) AS best FROM s GROUP BY id) SELECT p_partkey AS id,
  CASE WHEN best >= 1 THEN substr(p_name, 1, length(p_name) - cut) ELSE p_name END AS seq FROM part LEFT JOIN b ON p_partkey = id""")
def homopolymer_trim(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), trim_homopolymer(F.col("p_name"), 1).alias("seq"))


@query(f"""WITH {SEQ}, q AS (SELECT seq, translate(seq, 'ACGT', 'I5I!') AS qual FROM seqs),
  m AS (SELECT substr(seq, i, 4) AS mer, (NOT regexp_matches(substr(qual, i, 4), '!'))::INT AS high FROM q, unnest(range(1, length(seq) - 2)) AS u(i))
SELECT mer, least(1000, CASE WHEN max(high) = 1 THEN sum(high) ELSE count(*) END)::BIGINT AS "count", max(high) AS hq FROM m GROUP BY mer""")
def kmer_quality_windows(s, d):
    """k-mers whose bases all reach a quality count alone, where a k-mer has such occurrences."""
    x = sequences(s, d).withColumn("qual", F.translate("seq", "ACGT", "I5I!")).filter("length(seq) >= 4")
    o = x.select(F.inline(quality_kmers(F.col("seq"), F.col("qual"), 4, 10)))
    # equal windows are counted before the table is made
    pre = o.groupBy("mer", "high").agg(F.count("*").alias("n"))
    return kmers.quality_totals(pre, 1000)


@query("SELECT l_linenumber AS line, CASE WHEN l_quantity >= 25 THEN 'AC' ELSE 'N' END AS seq, count(*) AS n FROM lineitem GROUP BY ALL")
def read_validity(s, d):
    """Reads whose qualities have another length become a placeholder."""
    x = table(s, d, "lineitem").select("l_linenumber", sound_read(F.lit("r"), F.lit("AC"), F.when(F.col("l_quantity") >= 25, "II").otherwise("I")).alias("r"))
    return x.groupBy(F.col("l_linenumber").alias("line"), F.col("r.seq").alias("seq")).agg(F.count("*").alias("n"))
