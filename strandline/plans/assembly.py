"""Queries of k-mer graphs, read correction and paths; those without SQL are tested on fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coded, graph, hierarchy, joining, unitigs
from .adapters import MERS, sequences, table
from .registry import query


_UNITIG_SQL = f"""WITH RECURSIVE {MERS.replace("{k}", "13")}, kept AS (SELECT * FROM kc WHERE "count" >= 2),
nodes AS (SELECT mer, "count" FROM kept UNION SELECT reverse(translate(mer, 'ACGT', 'TGCA')), "count" FROM kept),
ends AS (SELECT substr(mer, 2) AS at_, mer AS a, NULL::VARCHAR AS b FROM nodes UNION ALL SELECT substr(mer, 1, 12), NULL::VARCHAR, mer FROM nodes),
one AS (SELECT min(a) AS a, min(b) AS b FROM ends GROUP BY at_ HAVING count(a) = 1 AND count(b) = 1),
links AS (SELECT a, b FROM one WHERE a <> b AND reverse(translate(a, 'ACGT', 'TGCA')) NOT IN (a, b) AND reverse(translate(b, 'ACGT', 'TGCA')) <> b),
walk AS (
  SELECT mer, mer AS seq, 1 AS n, "count" AS total FROM nodes WHERE mer NOT IN (SELECT b FROM links)
  UNION ALL SELECT nodes.mer, seq || right(nodes.mer, 1), n + 1, total + nodes."count" FROM walk JOIN links ON walk.mer = a JOIN nodes ON nodes.mer = b
), whole AS (SELECT seq, n, total FROM walk WHERE mer NOT IN (SELECT a FROM links)),
ring AS (SELECT mer, "count" FROM nodes WHERE mer NOT IN (SELECT mer FROM walk)),
tour AS (
  SELECT mer AS first_, mer, mer AS seq, 1 AS n, "count" AS total FROM ring
  UNION ALL SELECT first_, ring.mer, seq || right(ring.mer, 1), n + 1, total + ring."count"
  FROM tour JOIN links ON tour.mer = a JOIN ring ON ring.mer = b WHERE b <> first_
), least_ AS (SELECT first_ FROM tour GROUP BY first_ HAVING min(least(mer, reverse(translate(mer, 'ACGT', 'TGCA')))) = first_),
rings AS (SELECT max(seq) AS seq, n, max(total) AS total FROM tour JOIN least_ USING (first_) WHERE n = (SELECT max(n) FROM tour AS t
  WHERE t.first_ = tour.first_) GROUP BY first_, n)
SELECT DISTINCT seq, n::BIGINT AS kmers, round(total / n::DOUBLE, 6) AS coverage FROM (SELECT * FROM whole UNION ALL SELECT * FROM rings)
  WHERE seq <= reverse(translate(seq, 'ACGT', 'TGCA'))"""


@query(_UNITIG_SQL)
def unitig_build(s, d):
    """Unitigs of the 13-mers of all sequences that occur at least twice; the SQL walks link by link."""
    got = unitigs.build(coded.count_codes(sequences(s, d), 13, least=2), 13)
    return got.select("seq", "kmers", F.round("coverage", 6).alias("coverage"))


@query()
def read_correction(s, d):
    """All sequences against their own trusted 13-mers."""
    x = sequences(s, d)
    return unitigs.correct_reads(x, coded.count_codes(x, 13), 13, 3)


_PART = "e AS (SELECT p_partkey AS gene, p_brand AS contig, p_partkey * 10 AS l, p_partkey * 10 + p_size * 2 AS r FROM part)"


@query(f"""WITH {_PART}, w AS (SELECT *, max(r) OVER (PARTITION BY contig ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM e), c AS (SELECT *, sum(CASE WHEN reach IS NULL OR l > reach THEN 1 ELSE 0 END) OVER (PARTITION BY contig
  ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM w)
SELECT gene, min(gene) OVER (PARTITION BY contig, k) AS cluster FROM c""")
def gene_clusters(s, d):
    """Genes joined by overlapping exons; here each gene has one exon."""
    start = F.col("p_partkey") * 10
    e = table(s, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("contig"), F.lit("+").alias("strand"),
        start.alias("start"), (start + F.col("p_size") * 2).alias("end"))
    return graph.gene_clusters(e)


_PATHS = "us AS (SELECT l_orderkey AS id, l_linenumber AS k, (l_suppkey % 7)::VARCHAR || CASE WHEN l_linenumber % 2 = 0 THEN 'F' ELSE 'R' END AS u FROM lineitem), p AS (SELECT id, list(u ORDER BY k, u) AS path FROM us GROUP BY 1)"


def _paths(s, d):
    """Orders as paths of unitigs."""
    x = table(s, d, "lineitem")
    unit = F.concat((F.col("l_suppkey") % 7).cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "F").otherwise("R"))
    return x.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber",
        unit.alias("u")))).alias("us")).select("id", F.transform("us", lambda u: u["u"]).alias("path"))


@query(f"""WITH {_PATHS}
  SELECT array_to_string(path, '_') AS path, array_to_string(list_transform(list_reverse(path), lambda x: substr(x, 1, length(x) - 1) || CASE WHEN x LIKE '%F' THEN 'R' ELSE 'F' END), '_') AS back,
  count(*) AS n FROM p GROUP BY ALL""")
def path_reversal(s, d):
    """Names of paths and of the same paths read from the other end."""
    x = _paths(s, d)
    return x.groupBy(F.array_join("path", "_").alias("path"), F.array_join(graph.flipped(F.col("path")), "_").alias("back")).agg(F.count("*").alias("n"))


@query(f"""WITH {_PATHS}, q AS (SELECT path, min(id) AS id FROM p GROUP BY path), r AS (SELECT path, id, 'F' AS direction FROM q UNION ALL
  SELECT list_transform(list_reverse(path), lambda x: substr(x, 1, length(x) - 1) || CASE WHEN x LIKE '%F' THEN 'R' ELSE 'F' END), id, 'R' FROM q),
runs AS (SELECT id, o, path[o + 1:o + n] AS run FROM q, unnest(range(0, len(path))) AS u(o), unnest(range(1, len(path))) AS w(n) WHERE o + n <= len(path)),
h AS (SELECT r.id, runs.id AS container, r.direction, o FROM r JOIN runs ON runs.run = r.path AND runs.id <> r.id),
m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY container, direction, o) AS k FROM h) SELECT id, container, direction, o::INT AS "offset"
  FROM m WHERE k = 1""")
def path_reduction(s, d):
    """Distinct paths that lie in a longer one, in either direction."""
    x = _paths(s, d).groupBy("path").agg(F.min("id").alias("id"))
    return graph.reduced(x, both=True).withColumnRenamed("read", "id")


@query("""SELECT string_agg(c_custkey::VARCHAR || CASE WHEN c_custkey % 2 = 1 THEN 'R' ELSE 'F' END, ',' ORDER BY c_custkey) AS members,
string_agg(c_custkey::VARCHAR || 'F', '_'
  ORDER BY c_custkey) || '_' || (max(c_custkey) + CASE WHEN max(c_custkey) % 8 = 7 THEN 10000000 ELSE 1 END)::VARCHAR || 'F' AS path FROM customer
  GROUP BY c_custkey // 8""")
def path_merge(s, d):
    """Customers as paths from their number to the next, odd ones turned over; every eighth ends a chain."""
    key = F.col("c_custkey").cast("long")
    path = F.array(F.concat(key.cast("string"), F.lit("F")), F.concat((key + F.when(key % 8 == 7, 10000000).otherwise(1)).cast("string"), F.lit("F")))
    x = table(s, d, "customer").select(key.alias("id"), F.when(key % 2 == 1, graph.flipped(path)).otherwise(path).alias("path"))
    got = joining.merge_uniquely(x)
    return got.select(F.array_join(F.transform("members", lambda m: F.concat(m["id"].cast("string"),
        m["direction"])), ",").alias("members"), F.array_join("path", "_").alias("path"))


@query("""WITH p AS (SELECT o_orderkey AS parent, o_custkey AS id, o_orderstatus AS contig, ['+', '-', '.'][o_orderkey % 3 + 1] AS strand, o_orderkey AS s, o_orderkey + 5000 AS e
  FROM orders),
c AS (SELECT o_orderkey AS child, o_custkey AS id, o_orderstatus AS contig, ['+', '-'][o_orderkey % 2 + 1] AS strand, o_orderkey + 100 AS s, o_orderkey + 900 AS e
  FROM orders)
SELECT child, min(parent) AS parent FROM c
  LEFT JOIN p ON p.id = c.id AND p.contig = c.contig AND (p.strand = '.' OR p.strand = c.strand) AND abs(c.s - p.s) <= 7000000 AND c.s <= p.e AND p.s <= c.e
  GROUP BY child""")
def parent_resolve(s, d):
    """Orders as children and as parents whose id, the customer, is used many times."""
    o, key = table(s, d, "orders"), F.col("o_orderkey").cast("long")
    of = lambda *signs: F.element_at(F.array(*map(F.lit, signs)), (key % len(signs) + 1).cast("int"))
    parents = o.select(key.alias("parent"), F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("contig"), of("+", "-",
        ".").alias("strand"), key.alias("start"), (key + 5000).alias("end"), key.alias("ord"))
    children = o.select(key.alias("child"), F.col("o_custkey").alias("parent_id"), F.col("o_orderstatus").alias("contig"),
        of("+", "-").alias("strand"), (key + 100).alias("start"), (key + 900).alias("end"))
    return hierarchy.resolve_parents(children, parents)
