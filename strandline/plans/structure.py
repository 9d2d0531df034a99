"""Queries of transcripts side by side: class codes, guides beside reads, bundles, merged isoforms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.intervals import exon_overlap, exons_len, expand, set_cds
from ..functions.sequence import exon_of, pad_ends, to_genome, to_transcript
from ..operators import classes, guides, hierarchy, intervals, records, transcripts
from .adapters import IV, iv, table
from .adapters import guides as guide_rows
from .adapters import reads as read_rows
from .registry import query

#: Orders as transcripts that lie close: about ten share a locus; exons shift by a few bases, and some run on.
DENSE = """dx AS (
  SELECT DISTINCT l_orderkey AS tx, l_orderkey // 40 % 10 AS contig, CASE WHEN l_orderkey % 3 = 0 THEN '-' ELSE '+' END AS strand,
    l_orderkey // 40 * 2000 + l_linenumber * 200 + CASE WHEN l_partkey % 17 = 0 THEN 10 ELSE 0 END AS s,
    l_orderkey // 40 * 2000 + l_linenumber * 200 + 100 + CASE WHEN l_suppkey % 13 = 0 THEN 10 ELSE 0 END + CASE WHEN l_partkey % 19 = 0 THEN 220 ELSE 0 END AS e
  FROM lineitem
), dw AS (SELECT *, max(e) OVER (PARTITION BY tx ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM dx),
dc AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY tx ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
  FROM dw
), de AS (SELECT tx, any_value(contig) AS contig, any_value(strand) AS strand, min(s) AS s, max(e) AS e FROM dc GROUP BY tx, c),
dt AS (SELECT tx, any_value(contig) AS contig, any_value(strand) AS strand, min(s) AS s, max(e) AS e, list({'s': s, 'e': e} ORDER BY s) AS x FROM de GROUP BY tx),
di AS (SELECT *, list_transform(range(1, len(x)), lambda k: {'s': x[k].e + 1, 'e': x[k + 1].s - 1}) AS i FROM dt)"""


def dense(s, d):
    key, line = F.col("l_orderkey").cast("long"), F.col("l_linenumber")
    locus = F.floor(key / 40)
    base = locus * 2000 + line * 200
    start = base + F.when(F.col("l_partkey") % 17 == 0, 10).otherwise(0)
    end = base + 100 + F.when(F.col("l_suppkey") % 13 == 0, 10).otherwise(0) + F.when(F.col("l_partkey") % 19 == 0, 220).otherwise(0)
    strand = F.when(key % 3 == 0, "-").otherwise("+")
    x = table(s, d, "lineitem").select(key.alias("tx"), (locus % 10).alias("contig"), strand.alias("strand"), start.cast("long").alias("start"),
        end.cast("long").alias("end"))
    return transcripts.united(x, "tx", ("contig", "strand"))


_COMMON = """coalesce(list_sum(flatten(list_transform({a}, lambda p: list_transform({b}, lambda q: greatest(0, least(p.e, q.e) - greatest(p.s, q.s) + 1))))), 0)"""
_PAIRS = f"""{DENSE}, p AS (
  SELECT a.tx AS a, b.tx AS b, a.strand AS sa, b.strand AS sb, a.x AS m, b.x AS r, a.i AS im, b.i AS ir, a.s AS ms, a.e AS me, b.s AS rs, b.e AS re,
    len(a.x) AS nm, len(b.x) AS nr, list_sum(list_transform(a.x, lambda q: q.e - q.s + 1)) AS lm, list_sum(list_transform(b.x, lambda q: q.e - q.s + 1)) AS lr
  FROM di a JOIN di b ON a.contig = b.contig AND a.s <= b.e AND b.s <= a.e WHERE a.tx % 2 = 0 AND b.tx % 2 = 1
), pc AS (SELECT *, {_COMMON.format(a="m", b="r")} AS common FROM p)"""

_AT = "coalesce(nullif(list_position({}, true), 0), 1000000)"
_SLICE = "CASE WHEN len(list_filter({w}, lambda q: q = {p}[1])) > 0 AND {w}[list_position({w}, {p}[1]) : list_position({w}, {p}[1]) + len({p}) - 1] = {p} THEN list_position({w}, {p}[1]) ELSE 0 END"
_POKES = """
  len(list_filter({left}, lambda q: {lo} < q.s)) > 0 OR len(list_filter({right}, lambda q: {hi} > q.e)) > 0 AS {name}_cross,
  greatest(coalesce(list_max(list_transform(list_filter({left}, lambda q: q.s <= {lo} AND {lo} <= q.e), lambda q: q.e + 1 - {lo})), 0),
    coalesce(list_max(list_transform(list_filter({right}, lambda q: q.s <= {hi} AND {hi} <= q.e), lambda q: {hi} - q.s + 1)), 0)) AS {name}_poke"""
CODES = f"""{_PAIRS}, k1 AS (
  SELECT *, {_SLICE.format(p="im", w="ir")} AS at_r, {_SLICE.format(p="ir", w="im")} AS at_m,
    {_AT.format("list_transform(r, lambda q: ms <= q.e AND q.s <= me AND ms > q.s - 4 AND me < q.e + 4)")} AS in_exon,
    {_AT.format("list_transform(ir, lambda q: ms < q.s - 1 AND me > q.e + 1)")} AS over_intron,
    {_AT.format("list_transform(ir, lambda q: ms >= q.s AND me <= q.e)")} AS in_intron,
    {_AT.format("list_transform(m, lambda q: rs <= q.e AND q.s <= re AND rs > q.s - 4 AND re < q.e + 4)")} AS holds,
    {_AT.format("list_transform(im, lambda q: rs >= q.s AND re <= q.e)")} AS around,
    len(list_filter(ir, lambda q: least(me, q.e) - greatest(ms, q.s) + 1 >= 10 AND me - ms + 1 > least(me, q.e) - greatest(ms, q.s) + 11)) > 0 AS part,
    im[len(im)] AS last_m, ir[len(ir)] AS last_r
  FROM pc
), k2 AS (
  SELECT *, {_POKES.format(left="ir[1:at_r - 1]", right="ir[at_r + len(im):]", lo="ms", hi="me", name="m")},
    {_POKES.format(left="im[1:at_m - 1]", right="im[at_m + len(ir):]", lo="rs", hi="re", name="r")},
    len(list_filter(ir, lambda q: len(list_filter(m[1:nm - 1], lambda y: y.s < q.s AND q.e < y.e)) > 0)) > 0 AS within_,
    len(list_filter(ir, lambda q: q.s - 2 <= last_m.e AND q.e >= last_m.e)) > 0 AS blocked,
    list_filter(ir, lambda q: q.s - 2 > last_m.e)[1].e < me AS next_kept,
    len(list_filter(im, lambda q: NOT list_contains(ir, q) AND q.s <= re AND rs <= q.e AND NOT (list_contains(im, last_r) AND q.s > last_r.e))) > 0 AS conflict,
    list_has_any(list_transform(im, lambda q: q.s), list_transform(ir, lambda q: q.s)) OR list_has_any(list_transform(im, lambda q: q.e), list_transform(ir, lambda q: q.e)) AS site
  FROM k1
), codes AS (
  SELECT *, CASE
    WHEN nm = 1 AND nr = 1 THEN CASE WHEN ms = rs AND me = re THEN '=' WHEN lm > lr AND (common >= 0.8 * lm OR common >= 0.8 * lr AND common >= 0.7 * lm) THEN '~'
      WHEN lm <= lr AND common >= 0.8 * lr THEN '~' WHEN lm < lr AND common >= 0.8 * lm THEN 'c' WHEN lm >= lr AND common >= 0.8 * lr THEN 'k' ELSE 'o' END
    WHEN nm = 1 THEN CASE WHEN ms <= r[1].e AND me >= r[nr].s THEN 'm' WHEN in_exon < 1000000 AND in_exon <= least(over_intron, in_intron) THEN 'c'
      WHEN over_intron < in_intron THEN 'n' WHEN in_intron < 1000000 THEN 'i' WHEN part THEN 'e' ELSE 'o' END
    WHEN nr = 1 THEN CASE WHEN holds < 1000000 AND holds <= around THEN 'k' WHEN around < 1000000 THEN 'y' ELSE 'o' END
    WHEN in_intron < 1000000 THEN 'i'
    WHEN m[nm].s < r[1].e THEN CASE WHEN m[nm].e >= r[2].s THEN 'n' ELSE 'o' END
    WHEN r[nr].s < m[1].e THEN CASE WHEN m[1].s <= r[nr - 1].e THEN 'n' ELSE 'o' END
    WHEN im = ir THEN CASE WHEN ms = rs AND me = re THEN '=' ELSE '~' END
    WHEN at_r > 0 AND NOT m_cross AND m_poke < 4 THEN 'c'
    WHEN at_r = 0 AND at_m > 0 AND NOT r_cross AND r_poke < 4 THEN 'k'
    WHEN within_ OR NOT blocked AND coalesce(next_kept, false) OR at_r > 0 AND m_cross THEN
      CASE WHEN NOT conflict AND (at_r > 0 OR at_m = 0 OR r_poke < 4) AND (at_r = 0 OR m_poke < 4) THEN 'm' ELSE 'n' END
    WHEN site THEN 'j' WHEN common > 4 THEN 'o' WHEN ms > rs AND re > me THEN 'i' ELSE 'y' END AS code
  FROM k2
)"""


def _dense_pairs(s, d):
    tx = dense(s, d).withColumn("introns", transcripts.introns(F.col("exons")))
    return intervals.overlap_join(tx.filter("tx % 2 = 0"), tx.filter("tx % 2 = 1"))


@query(f"WITH {CODES} SELECT a AS a_tx, b AS b_tx, code FROM codes")
def class_code(s, d):
    """The code of each pair of an even and an odd transcript that overlap."""
    return _dense_pairs(s, d).select("a_tx", "b_tx", classes.class_code(*(F.col(c) for c in ("a_exons",
        "b_exons")), im=F.col("a_introns"), ir=F.col("b_introns")).alias("code"))


_RANK = "CASE code " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in classes.RANK.items()) + " END"


@query(f"""WITH {CODES}, meets AS (
  SELECT a, b, CASE WHEN sa = sb THEN code
    WHEN len(list_filter(im, lambda q: len(list_filter(ir, lambda y: q.s <= y.e AND y.s <= q.e)) > 0)) > 0 THEN 's' WHEN common > 0 THEN 'x' ELSE code END AS code, common
  FROM codes
), runs AS (
  SELECT a.tx AS a, b.tx AS b, 'p' AS code, 0 AS common FROM dt a JOIN dt b ON a.contig = b.contig AND a.strand = b.strand AND a.tx % 2 = 0 AND b.tx % 2 = 1
    AND CASE WHEN a.strand = '-' THEN b.s - a.e ELSE a.s - b.e END BETWEEN 1 AND 2000
), ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY {_RANK}, common DESC, b) AS k FROM (SELECT * FROM meets UNION ALL SELECT * FROM runs))
SELECT tx AS id, coalesce(code, CASE WHEN tx % 10 = 0 THEN 'r' ELSE 'u' END) AS code, b AS ref FROM dt LEFT JOIN ranked ON tx = a AND k = 1 WHERE tx % 2 = 0""")
def class_best(s, d):
    """The best code of each even transcript, strands considered; s, x, p, r and u among them."""
    tx = dense(s, d).withColumnRenamed("tx", "id")
    even = tx.filter("id % 2 = 0").withColumn("repeat_share", F.when(F.col("id") % 10 == 0, 0.7).otherwise(0.1))
    return classes.classify(even, tx.filter("id % 2 = 1"))


@query(f"WITH {_PAIRS} SELECT a AS a_tx, b AS b_tx, common::BIGINT AS shared FROM pc")
def exon_overlap_len(s, d):
    """Bases that the exons of two transcripts share."""
    return _dense_pairs(s, d).select("a_tx", "b_tx", exon_overlap(F.col("a_exons"), F.col("b_exons")).alias("shared"))


@query(f"""WITH {_PAIRS} SELECT a AS a_tx, b AS b_tx FROM pc WHERE CASE WHEN nm = 1 AND nr = 1 THEN common / greatest(lm, lr)::DOUBLE >= 0.8
  ELSE im = ir AND nm = nr AND abs(ms - rs) <= 15 AND abs(me - re) <= 15 END""")
def tx_structure(s, d):
    """Pairs of one structure: equal introns and ends at most 15 bases apart, or single exons that share 80 %."""
    return _dense_pairs(s, d).filter(transcripts.structure_match(F.col("a_exons"), F.col("b_exons"), 0.8, 15)).select("a_tx", "b_tx")


@query(f"WITH {DENSE} SELECT tx, min(tx) OVER (PARTITION BY contig, strand, i) AS first_tx FROM di WHERE len(i) > 0")
def tx_structure_match(s, d):
    """Transcripts with one intron chain as a group named by its first: membership, not pairs."""
    tx = dense(s, d)
    chains = transcripts.merge_by_chain(tx, "tx").select("contig", "strand", "chain", "first_tx")
    return tx.withColumn("chain", transcripts.introns(F.col("exons"))).join(chains, ["contig", "strand", "chain"]).select("tx", "first_tx")


@query(f"""WITH {DENSE}, c AS (SELECT tx, s + 15 AS cs, e - 15 AS ce, x FROM dt),
q AS (SELECT tx, cs, ce, list_transform(list_filter(x, lambda q: q.s <= ce AND cs <= q.e), lambda q: least(q.e, ce) - greatest(q.s, cs) + 1) AS n FROM c)
SELECT tx, cs AS cds_start, ce AS cds_end, len(n)::BIGINT AS parts, list_sum(n)::BIGINT AS bases FROM q""")
def cds_from_span(s, d):
    """A coding span put on a transcript, and what it has of the exons."""
    tx = dense(s, d).withColumn("c", set_cds(F.col("exons"), F.col("start") + 15, F.col("end") - 15))
    return tx.select("tx", F.col("c.start").alias("cds_start"), F.col("c.end").alias("cds_end"), F.size("c.parts").cast("long").alias("parts"),
        exons_len(F.col("c.parts")).alias("bases"))


@query(f"""WITH {DENSE}, b AS (SELECT *, flatten(list_transform(x, lambda q: range(q.s, q.e + 1))) AS g FROM dt), o AS (SELECT *,
  CASE WHEN strand = '-' THEN list_reverse(g) ELSE g END AS h FROM b)
SELECT tx, h[120] AS pos, list_position(h, (s + e) // 2)::BIGINT AS place, coalesce(list_position(list_transform(x, lambda q: q.s <= (s + e) // 2 AND (s + e) // 2 <= q.e), true), 0)::BIGINT AS exon,
  s - 7 AS padded_start, e + 7 AS padded_end, greatest(s - 50, 1) AS wide_start, e + 50 AS wide_end FROM o""")
def coordinate_maps(s, d):
    """Places in a spliced transcript and in the genome, the exon of a position, wider ends."""
    x, strand, mid = F.col("exons"), F.col("strand"), F.floor((F.col("start") + F.col("end")) / 2)
    tx = dense(s, d).withColumns({"pad": pad_ends(x, 7), "wide": expand(F.col("start"), F.col("end"), 50)})
    return tx.select("tx", to_genome(x, strand, F.lit(120)).alias("pos"), to_transcript(x, strand, mid).alias("place"), exon_of(x, mid).cast("long").alias("exon"),
                     F.element_at("pad", 1)["start"].alias("padded_start"), F.element_at("pad", -1)["end"].alias("padded_end"),
                         F.col("wide.start").alias("wide_start"), F.col("wide.end").alias("wide_end"))


# --- guides beside reads ---------------------------------------------------------------------

_RG = IV + """, r AS (SELECT *, CASE WHEN id % 6 = 0 THEN "start" + id % 7 * 40 END AS mate FROM iv WHERE id % 2 = 0),
  g AS (SELECT *, (id % 4 = 1)::INT AS is_real FROM iv WHERE id % 2 = 1),
ov AS (
  SELECT r.id AS a_id, g.id AS b_id, r."start" AS a_start, r."end" AS a_end, r.strand AS a_strand, g.strand AS b_strand, is_real AS b_real,
    least(r."end", g."end") - greatest(r."start", g."start") + 1 AS ovlen, coalesce(mate > 0 AND mate + 10 > g."start" AND mate + 5 < g."end", false)::INT AS mate_ovl
  FROM r JOIN g ON r.contig = g.contig AND r."start" <= g."end" AND g."start" <= r."end"
), ex AS (SELECT * FROM ov WHERE (a_strand = '.' OR a_strand = b_strand) AND (ovlen >= least(5, a_end - a_start + 1) OR mate_ovl = 1)),
top AS (SELECT *, max(b_real * 2 + mate_ovl) OVER (PARTITION BY a_id) AS best_kind FROM ex),
best AS (SELECT * FROM (SELECT *, max(ovlen) OVER (PARTITION BY a_id) AS best FROM top WHERE b_real * 2 + mate_ovl = best_kind) WHERE ovlen + 5 >= best)"""


def _mated(s, d):
    r = read_rows(s, d).withColumn("mate", F.when(F.col("id") % 6 == 0, F.col("start") + F.col("id") % 7 * 40))
    return r, guide_rows(s, d).withColumn("real", (F.col("id") % 4 == 1).cast("int"))


def _exons(s, d):
    return guides.exon_overlaps(*_mated(s, d))


@query(f"WITH {_RG} SELECT a_id, b_id, ovlen, mate_ovl FROM ex")
def exon_guide_overlaps(s, d):
    """Overlaps of read exons and guide exons that count: five bases or the whole read exon, or the mate inside."""
    return _exons(s, d).select("a_id", "b_id", "ovlen", "mate_ovl")


@query(f"WITH {_RG} SELECT a_id, b_id, ovlen, mate_ovl, b_real FROM best")
def exon_guide_best(s, d):
    """As good as the best: real guides first, then those with the mate, then the longest less five bases."""
    return guides.best_of_reads(*_mated(s, d), "id").select("a_id", "b_id", "ovlen", "mate_ovl", "b_real")


@query(f"""WITH {_RG} SELECT a_id AS id, min(b_strand) AS strand FROM best WHERE a_strand = '.' AND b_strand IN ('+', '-') GROUP BY a_id
  HAVING min(b_strand) = max(b_strand)""")
def guide_strand(s, d):
    """The strand that all best guide exons of a read without one agree on."""
    r, g = _mated(s, d)
    return guides.guide_strand(guides.best_of_reads(r.filter("strand = '.'"), g, "id"), "a_id").withColumnRenamed("a_id", "id")


@query(f"""WITH {_RG}, m AS (SELECT a_id, max(ovlen) AS best FROM ex GROUP BY a_id) SELECT id, coalesce(best, 0) >= "end" - "start" + 1 AS in_guide
  FROM r LEFT JOIN m ON id = a_id""")
def read_in_guide(s, d):
    """Whether guide exons cover all exons of a read whole."""
    return guides.full_overlap(read_rows(s, d), _exons(s, d), "id")


_GB = IV + """, u AS (SELECT id, contig, "start" AS s, "end" AS e, id % 3 <> 0 AS is_read FROM iv),
w AS (SELECT *, max(e) OVER (PARTITION BY contig ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u),
c AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY contig
  ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM w),
pieces AS (SELECT contig, k, min(s) AS s, max(e) AS e, count(*) FILTER (is_read) AS n, min(s) FILTER (is_read) AS first_read FROM c GROUP BY contig, k
  HAVING count(*) FILTER (is_read) > 0),
f AS (SELECT *, CASE WHEN first_read <= lag(e) OVER (PARTITION BY contig ORDER BY s) + 200 THEN 0 ELSE 1 END AS fresh FROM pieces),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY s)::BIGINT AS bundle FROM f),
bd AS (SELECT contig, bundle, min(s) AS s, max(e) AS e, sum(n)::BIGINT AS n_reads FROM b GROUP BY contig, bundle)"""


def _guided(s, d):
    x = iv(s, d)
    return x.filter("id % 3 <> 0"), x.filter("id % 3 = 0")


@query(f'WITH {_GB} SELECT contig, bundle, s AS bundle_start, e AS bundle_end, n_reads FROM bd')
def guided_bundles(s, d):
    """Bundles of reads that pull in the guides they overlap, and the guides that overlap these."""
    r, g = _guided(s, d)
    return guides.bundles(r, g).select("contig", "bundle", F.col("start").alias("bundle_start"), F.col("end").alias("bundle_end"), "n_reads")


@query(f'WITH {_GB} SELECT u.id, bundle FROM u LEFT JOIN bd ON u.contig = bd.contig AND u.s <= bd.e AND bd.s <= u.e WHERE NOT is_read')
def guides_pulled_in(s, d):
    """The bundle of each guide; null for guides that no read leads to."""
    r, g = _guided(s, d)
    return guides.pulled_in(guides.bundles(r, g), g)


@query(f"WITH {IV} SELECT id, contig FROM iv WHERE contig NOT IN (3, 7, 11)")
def contigs_excluded(s, d):
    """Reads on other contigs than a list of names."""
    return guides.without_contigs(iv(s, d), "3, 7\t11").select("id", "contig")


@query("SELECT o_orderkey // 50 AS contig, o_orderkey % 50 AS start_, o_orderkey AS line FROM orders")
def order_checked(s, d):
    """Rows in the order of their contigs and starts, which ends the query where it is broken."""
    key = F.col("o_orderkey")
    x = table(s, d, "orders").select(F.floor(key / 50).alias("contig"), (key % 50).alias("start_"), key.alias("line"))
    return guides.checked_order(x, "line", "contig", "start_")


@query(f"""WITH {IV}, w AS (SELECT contig, "start" AS s, "end" AS e FROM iv WHERE id % 2 = 1) SELECT id FROM iv WHERE id % 2 = 0 AND EXISTS (SELECT 1
  FROM w WHERE w.contig = iv.contig AND iv."start" <= w.e AND w.s <= iv."end")""")
def reads_in_regions(s, d):
    """Reads that overlap any of many regions, which are united first."""
    x = iv(s, d)
    return guides.in_regions(x.filter("id % 2 = 0"), x.filter("id % 2 = 1"), "id").select("id")


# --- sets of transcripts ---------------------------------------------------------------------

_MERGE = f"""{DENSE}, chains AS (
  SELECT contig, strand, i, min(s) AS s, max(e) AS e, count(*) AS n, min(tx) AS first_tx FROM di WHERE len(i) > 0 GROUP BY contig, strand, i
), held AS (

  SELECT contig, strand, s, e, list_transform(range(0, len(i) + 1), lambda k: {{'s': CASE WHEN k = 0 THEN s ELSE i[k].e + 1 END, 'e': CASE WHEN k = len(i) THEN e ELSE i[k + 1].s - 1 END}}) AS x, n, first_tx
  FROM chains
), hx AS (SELECT contig, strand, unnest(x) AS q FROM held),
one AS (SELECT *, max(e) OVER (PARTITION BY contig, strand ORDER BY s, e, tx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM dt WHERE len(x) = 1),
oc AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY contig, strand
  ORDER BY s, e, tx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM one),
ou AS (SELECT contig, strand, min(s) AS s, max(e) AS e, count(*) AS n, min(tx) AS first_tx FROM oc GROUP BY contig, strand, c),
kept AS (
  SELECT contig, strand, s, e, x, n, first_tx FROM held UNION ALL
  SELECT contig, strand, s, e, [{{'s': s, 'e': e}}], n, first_tx FROM ou WHERE NOT EXISTS (SELECT 1 FROM hx
  WHERE hx.contig = ou.contig AND hx.strand = ou.strand AND ou.s >= q.s AND ou.e <= q.e)
), kw AS (SELECT *, max(e) OVER (PARTITION BY contig, strand ORDER BY s, e, first_tx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM kept),
kc AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY contig, strand
  ORDER BY s, e, first_tx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM kw),
kg AS (SELECT *, dense_rank() OVER (ORDER BY contig, strand, c) AS g, row_number() OVER (PARTITION BY contig, strand, c ORDER BY s, e, x) AS k FROM kc)"""


@query(f"""WITH {_MERGE}
  SELECT 'MSTRG.' || g AS gene_id, 'MSTRG.' || g || '.' || k AS transcript_id, contig, strand, s AS tx_start, e AS tx_end, len(x)::INT AS n_exons, n, first_tx
  FROM kg""")
def merge_mode(s, d):
    """Transcripts as one set without repeats: chains with their widest ends, single exons, labelled genes."""
    got = transcripts.merge_isoforms(dense(s, d), "tx", gap=50)
    return got.select("gene_id", "transcript_id", "contig", "strand", F.element_at("exons", 1)["start"].alias("tx_start"),
        F.element_at("exons", -1)["end"].alias("tx_end"), F.size("exons").alias("n_exons"), "n", "first_tx")


@query(f"""WITH {DENSE},
  v AS (SELECT tx, list_sum(list_transform(x, lambda q: q.e - q.s + 1)) AS n, tx % 7 - 1 AS cov, (tx % 5)::DOUBLE AS fpkm, nullif(tx % 4, 3)::DOUBLE AS tpm
  FROM dt) SELECT tx FROM v WHERE n >= 150 AND (cov < 0 OR cov >= 2) AND fpkm >= 1 AND (tpm IS NULL OR tpm >= 1)""")
def tx_passing(s, d):
    """Transcripts that reach a length and least coverage, FPKM and TPM; what is missing passes."""
    c = F.col("tx")
    tx = dense(s, d).withColumns({"cov": c % 7 - 1, "fpkm": (c % 5).cast("double"), "tpm": F.nullif(c % 4, F.lit(3)).cast("double")})
    return transcripts.passing(tx, 150, 2, 1, 1).select("tx")


@query(f"""WITH {DENSE}, t AS (SELECT tx, s, e, CASE WHEN tx % 4 = 0 THEN [] ELSE x END AS x FROM dt) SELECT tx,
  CASE WHEN len(x) = 0 THEN 1 ELSE len(x) END::BIGINT AS n_exons,
  CASE WHEN len(x) = 0 THEN e - s + 1 ELSE list_sum(list_transform(x, lambda q: q.e - q.s + 1)) END::BIGINT AS covlen FROM t""")
def implicit_exons(s, d):
    """Transcripts without exons get one over their span."""
    tx = hierarchy.with_exons(dense(s, d).withColumn("exons", F.when(F.col("tx") % 4 != 0, F.col("exons"))))
    return tx.select("tx", F.size("exons").cast("long").alias("n_exons"), exons_len(F.col("exons")).alias("covlen"))


@query(f"""WITH {DENSE}, t AS (SELECT tx, s, CASE WHEN tx % 3 = 0 THEN s + tx % 20 ELSE e END AS e, len(x) AS n, tx % 2 = 0 AS made FROM dt) SELECT tx
  FROM t WHERE NOT (made AND e - s < 10 AND n <= 1)""")
def stray_records(s, d):
    """Without tiny records that a child exon alone called for."""
    c = F.col("tx")
    tx = dense(s, d).withColumns({"end": F.when(c % 3 == 0, F.col("start") + c % 20).otherwise(F.col("end")), "made_by_exon": c % 2 == 0})
    return hierarchy.without_stray_records(tx).select("tx")


_KINDS = ["exon", "CDS", "five_prime_UTR", "start_codon", "stop_codon", "mRNA", "lnc_RNA", "primary_transcript", "V_gene_segment", "gene",
    "pseudogene", "intron", "match", "selenocysteine"]


@query(f"""WITH k AS (SELECT l_linenumber % 7 * 2 + l_suppkey % 2 AS n, count(*) AS n_rows FROM lineitem GROUP BY 1),
  f AS (SELECT {_KINDS!r}[n + 1] AS feature, n_rows FROM k)
SELECT feature,
  CASE WHEN lower(feature) LIKE '%utr%' THEN 'utr' WHEN lower(feature) LIKE '%exon' THEN 'exon' WHEN feature = 'stop_codon' THEN 'stop_codon' WHEN feature = 'start_codon' THEN 'start_codon' WHEN feature = 'CDS' THEN 'cds'
  WHEN lower(feature) LIKE '%intron' THEN 'intron' WHEN lower(feature) LIKE '%rna' OR lower(feature) LIKE '%transcript' THEN 'transcript' WHEN lower(feature) LIKE '%\\_gene\\_segment' ESCAPE '\\' THEN 'gene_segment'
  WHEN lower(feature) LIKE '%gene' OR lower(feature) LIKE 'gene%' THEN 'gene' ELSE 'other' END AS kind, n_rows FROM f""")
def feature_kinds(s, d):
    """What kind of feature a name stands for."""
    n = (F.col("l_linenumber") % 7 * 2 + F.col("l_suppkey") % 2).cast("int")
    x = table(s, d, "lineitem").groupBy(n.alias("n")).agg(F.count("*").alias("n_rows")).withColumn("feature", F.get(F.array(*map(F.lit, _KINDS)), F.col("n")))
    return x.select("feature", hierarchy.feature_kind(F.col("feature")).alias("kind"), "n_rows")


@query("""WITH c AS (SELECT l_orderkey AS p, l_orderkey % 10 AS contig,
  CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand, l_partkey * 10 AS s, l_partkey * 10 + l_quantity::BIGINT AS e FROM lineitem)
SELECT p AS id, contig, strand, min(s) AS tx_start, max(e) AS tx_end, count(*)::INT AS n_exons FROM c WHERE p NOT IN (SELECT o_orderkey FROM orders
  WHERE o_orderkey % 3 > 0) GROUP BY p, contig, strand""")
def parts_promoted(s, d):
    """Parts whose parent no record defines become transcripts of their own."""
    x = table(s, d, "lineitem")
    strand = F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise("+")
    start = F.col("l_partkey") * 10
    parts = x.select(F.col("l_orderkey").alias("parent_id"), (F.col("l_orderkey") % 10).alias("contig"), strand.alias("strand"), start.alias("start"),
        (start + F.col("l_quantity").cast("long")).alias("end"))
    parents = table(s, d, "orders").filter("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("id"))
    got = hierarchy.promoted(parts, parents)
    return got.select("id", "contig", "strand", F.col("start").alias("tx_start"), F.col("end").alias("tx_end"), F.size("exons").alias("n_exons"))


@query(f"WITH {DENSE} SELECT tx, row_number() OVER (PARTITION BY contig ORDER BY s, tx % 3, e, tx) AS place FROM dt")
def tx_places(s, d):
    """The place of each transcript on its contig by start, level, end and id."""
    tx = records.by_place(dense(s, d).withColumnRenamed("tx", "id").withColumn("level", F.col("id") % 3))
    place = F.row_number().over(Window.partitionBy("contig").orderBy("start", "level", "end", "id"))
    return tx.select(F.col("id").alias("tx"), place.cast("long").alias("place"))


@query("""WITH RECURSIVE x AS (SELECT DISTINCT l_orderkey AS key,
  CASE WHEN l_linenumber % 2 = 0 THEN 'CDS' ELSE 'exon' END AS kind, l_partkey % 60 * 5 AS s, l_partkey % 60 * 5 + l_quantity::BIGINT % 12 AS e
  FROM lineitem),
o AS (SELECT key, kind, s, e, row_number() OVER (PARTITION BY key ORDER BY s, e, kind) AS k FROM x),
r AS (
  SELECT key, k, s, e, kind, 1 AS u FROM o WHERE k = 1 UNION ALL
  SELECT o.key, o.k, CASE WHEN held OR meets THEN r.s ELSE o.s END, CASE WHEN held THEN r.e WHEN meets THEN greatest(r.e, o.e) ELSE o.e END,
    CASE WHEN held THEN r.kind WHEN meets THEN CASE WHEN r.kind = 'CDS' OR o.kind = 'CDS' THEN 'CDS' ELSE r.kind END ELSE o.kind END, CASE WHEN held OR meets THEN r.u ELSE r.u + 1 END
  FROM r JOIN o ON o.key = r.key AND o.k = r.k + 1,
    LATERAL (SELECT o.s >= r.s AND o.e <= r.e AS held, CASE WHEN r.kind = 'CDS' AND o.kind = 'CDS' THEN o.s = r.e + 1 ELSE o.s <= r.e + 1 END AS meets) t
) SELECT key, arg_max(kind, k) AS kind, arg_max(s, k) AS part_start, arg_max(e, k) AS part_end FROM r GROUP BY key, u""")
def parts_joined(s, d):
    """Exon and CDS parts as one where they overlap or touch, but two CDS only where they touch."""
    at = F.col("l_partkey") % 60 * 5
    kind = F.when(F.col("l_linenumber") % 2 == 0, "CDS").otherwise("exon")
    x = table(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), kind.alias("kind"), at.alias("start"),
        (at + F.col("l_quantity").cast("long") % 12).alias("end")).distinct()
    return hierarchy.joined_parts(x).select("key", "kind", F.col("start").alias("part_start"), F.col("end").alias("part_end"))


_OWNERS = """, u AS (SELECT contig, s, e, strand, row_number() OVER (ORDER BY contig, s, e, strand) AS id FROM (SELECT DISTINCT contig, s, e, strand FROM {t}))
SELECT u.id, {t}.tx AS owner FROM {t} JOIN u USING (contig, s, e, strand)"""


@query(f"WITH {DENSE}" + _OWNERS.format(t="de"))
def exon_owners(s, d):
    """Which transcripts an exon belongs to, exons numbered by place: the bridge table of exons."""
    x = dense(s, d).select("tx", "contig", "strand", F.explode("exons").alias("q")).select("tx", "contig", "strand", "q.start", "q.end")
    return transcripts.features(x, "tx").select("id", F.explode("owners").alias("owner"))


@query(f"WITH {DENSE}, it AS (SELECT tx, contig, strand, q.s AS s, q.e AS e FROM (SELECT *, unnest(i) AS q FROM di))" + _OWNERS.format(t="it"))
def intron_owners(s, d):
    """Which transcripts an intron belongs to: the bridge table of introns."""
    tx = dense(s, d)
    x = tx.select("tx", "contig", "strand", F.explode(transcripts.introns(F.col("exons"))).alias("q")).select("tx", "contig", "strand", "q.start", "q.end")
    return transcripts.features(x, "tx").select("id", F.explode("owners").alias("owner"))
