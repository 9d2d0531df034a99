"""Queries of records, k-mers, placements, variants, positions and functions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.intervals import coord_match
from ..functions.sequence import reformat, revcomp, spliced
from ..functions.variants import sample_field, with_entry, without_entries
from ..operators import graph, kmers, records, unitigs, variants
from ..streaming.bundles import stream_bundles, stream_lookup
from .adapters import IV, MERS, SEQ, iv, seconds, sequences, table
from .registry import query

K5 = MERS.replace("{k}", "5")


def _of(column: Column, *values: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), column.cast("int"))


# --- records ---------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(source, 'src1') ORDER BY doc_id LIMIT 40")
def header_grep_first(s, d):
    """The first headers without a pattern: the limit is the search's own option."""
    return records.grep(table(s, d, "documents"), "source", "src1", invert=True, most=40, order=("doc_id",)).select("doc_id")


@query("SELECT doc_id, array_to_string(list_sort(string_split(text, chr(10))), chr(10)) AS text FROM documents WHERE text IS NOT NULL")
def lines_sorted(s, d):
    """Each record's lines in order."""
    return records.sorted_lines(table(s, d, "documents").select("doc_id", "text"), "text").filter("text is not null")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 99")
def from_hundredth(s, d):
    """All records from the hundredth on."""
    return records.from_nth(table(s, d, "orders").select("o_orderkey"), 100, "o_orderkey")


@query("""WITH r AS (SELECT doc_id, sum(greatest(n_chars, 1)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM documents) SELECT doc_id
  FROM r WHERE run <= 20000""")
def head_of_bytes(s, d):
    """The first records that fit into a number of bytes: an option of the tool."""
    return records.head_bytes(table(s, d, "documents").select("doc_id", "n_chars"), 20000, "n_chars", "doc_id").select("doc_id")


@query("""SELECT doc_id, n_chars AS size, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at
  FROM documents""")
def sizes_with_offsets(s, d):
    """Sizes of records and where each begins."""
    x = table(s, d, "documents").select("doc_id", F.col("n_chars").alias("size"))
    return records.with_offsets(x, "doc_id", "size", block=64)


@query("""WITH r AS (SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM documents) SELECT doc_id FROM r WHERE place BETWEEN 5000 AND 90000""")
def records_in_bytes(s, d):
    """Records that begin within a range of bytes: the range is the tool's option."""
    x = records.with_offsets(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", block=64)
    return records.in_bytes(x, 5000, 90000).select("doc_id")


@query("SELECT o_orderkey * 2 AS ord, 'a' || o_custkey AS name FROM orders UNION ALL SELECT o_orderkey * 2 + 1, 'b' || o_custkey FROM orders")
def mates_interleaved(s, d):
    """Two files of mates in turn."""
    o = table(s, d, "orders")
    of = lambda sign: o.select(F.col("o_orderkey").alias("ord"), F.concat(F.lit(sign), "o_custkey").alias("name"))
    return records.interleave(of("a"), of("b"))


@query("""WITH p AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand FROM part)
SELECT id, rank() OVER (ORDER BY brand) AS by_text, rank() OVER (ORDER BY lower(name), name) AS by_nocase, rank() OVER (ORDER BY regexp_extract(brand, '-?[0-9]+', 0)::INT, brand) AS by_number
  FROM p""")
def header_orders(s, d):
    """Places by a header as text, without case, and by its first number."""
    x = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    place = lambda column, how: F.rank().over(Window.orderBy(*records.order_keys(column, how))).cast("long")
    return x.select("id", place("brand", "text").alias("by_text"), place("name", "nocase").alias("by_nocase"), place("brand", "number").alias("by_number"))


@query(f"""WITH {IV}, f AS (SELECT id, min(id) OVER (PARTITION BY gene, strand, nh, contig) AS first_ FROM iv),
  p AS (SELECT a.first_ AS x, b.first_ AS y FROM f a JOIN f b ON b.id = a.id + 1 AND a.id % 2 = 0)
SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS pairs FROM p GROUP BY 1, 2""")
def collapsed_pairs(s, d):
    """How many pairs of mates link two collapsed alignments."""
    reads = iv(s, d).select(F.col("id").alias("read"), "gene", "strand", "nh", "contig")
    pairs = reads.filter("read % 2 = 0").select(F.col("read").alias("a"), (F.col("read") + 1).alias("b"))
    return records.pair_links(reads, pairs, "gene", "strand", "nh", "contig")


# --- k-mers ----------------------------------------------------------------------------------


@query(f"""WITH {K5}, q AS (SELECT DISTINCT least(m, reverse(translate(m, 'ACGT', 'TGCA'))) AS mer
  FROM (SELECT ['ACGTA', 'TTTTT', 'GATTA', 'CCCCC', 'TACGT', 'AAAAA'][n_nationkey % 6 + 1] AS m FROM nation))
  SELECT mer, coalesce(\"count\", 0) AS \"count\" FROM q LEFT JOIN kc USING (mer)""")
def kmer_seeded(s, d):
    """Counts of the k-mers that a list names, and of no others."""
    seeds = table(s, d, "nation").select(_of(F.col("n_nationkey") % 6, "ACGTA", "TTTTT", "GATTA", "CCCCC", "TACGT", "AAAAA").alias("mer"))
    return kmers.count_seeded(sequences(s, d), seeds, 5)


@query(f"""WITH {SEQ}, mers AS (SELECT id, substr(seq, i, 5) AS m FROM seqs, unnest(range(1, length(seq) - 3)) AS u(i)),
  canon AS (SELECT id, least(m, reverse(translate(m, 'ACGT', 'TGCA'))) AS mer FROM mers)
SELECT mer, count(*) AS "count" FROM canon WHERE mer IN (SELECT mer FROM canon WHERE id % 10 = 0) GROUP BY mer""")
def kmer_updated(s, d):
    """A table of some sequences with the counts of the others added; no new k-mers come in."""
    x = sequences(s, d)
    return kmers.updated(kmers.count_kmers(x.filter("id % 10 = 0"), 5), x.filter("id % 10 <> 0"), 5)


@query(f"""WITH {K5} SELECT count(*) FILTER (\"count\" = 1) AS uniq,
  count(*) AS distinct_mers, coalesce(sum(\"count\"), 0)::BIGINT AS total, coalesce(max(\"count\"), 0) AS max_count FROM kc
  WHERE \"count\" BETWEEN 20 AND 900""")
def kmer_stats_bounds(s, d):
    return kmers.stats(kmers.count_kmers(sequences(s, d), 5), 20, 900)


@query("""WITH m AS (SELECT l_partkey AS mer, max((l_quantity >= 25)::INT) AS hq, sum((l_quantity >= 25)::INT) AS h, count(*) AS n FROM lineitem
  GROUP BY 1), c AS (SELECT hq, least(31, CASE WHEN hq = 1 THEN h ELSE n END) AS c FROM m)
SELECT least(c, 20)::BIGINT AS "count", count(*) FILTER (hq = 0) AS low, count(*) FILTER (hq = 1) AS high FROM c GROUP BY 1""")
def kmer_quality_histo(s, d):
    """k-mers by count and quality, the last count holding what is over it."""
    o = table(s, d, "lineitem").select(F.col("l_partkey").alias("mer"), (F.col("l_quantity") >= 25).cast("int").alias("high"))
    return kmers.quality_histogram(kmers.quality_counts(o, 31), 20)


@query("WITH c AS (SELECT n_chars AS size FROM documents) SELECT count(*) AS records, max(size) AS longest, sum(size)::BIGINT AS bases FROM c")
def length_stats(s, d):
    return kmers.length_stats(table(s, d, "documents"), "n_chars")


@query("""WITH c AS (SELECT n_chars AS size, sum(n_chars) OVER (ORDER BY n_chars DESC) AS run FROM documents)
  SELECT max(size) FILTER (run * 100 >= 100000 * 50) AS n50, max(size) FILTER (run * 100 >= 100000 * 90) AS n90, sum(size)::BIGINT AS total,
  count(*) AS records, round(avg(size), 6) AS average, round(sum(size::DOUBLE * size) / sum(size), 6) AS e_size FROM c""")
def nx_of_genome(s, d):
    """N50 and N90 against the size of a genome, the average and the E-size."""
    x = kmers.nx(table(s, d, "documents"), (50, 90), "n_chars", 100000, block=256)
    return x.select("n50", "n90", "total", "records", F.round("average", 6).alias("average"), F.round("e_size", 6).alias("e_size"))


@query(f"WITH {SEQ} SELECT id, length(seq) AS bases, length(replace(seq, 'G', '')) AS without_g FROM seqs")
def bases_per_read(s, d):
    x = F.col("seq")
    return sequences(s, d).select("id", F.length(x).cast("long").alias("bases"), F.length(F.replace(x, F.lit("G"), F.lit(""))).cast("long").alias("without_g"))


# --- unitigs and placements ------------------------------------------------------------------

_UNITS = """{seq}, u AS (SELECT id AS unitig, substr(seq, 20, 30) AS s FROM seqs WHERE id % 4 = 0 AND length(seq) >= 60), r AS (SELECT id, seq FROM seqs),
um AS (SELECT unitig, i - 1 AS u_at, substr(s, i, 15) AS m FROM u, unnest(range(1, length(s) - 13)) AS t(i)),
  rm AS (SELECT id, i - 1 AS r_at, substr(seq, i, 15) AS m FROM r, unnest(range(1, length(seq) - 13)) AS t(i)),
uc AS (SELECT *, least(m, reverse(translate(m, 'ACGT', 'TGCA'))) AS c FROM um), rc AS (SELECT *, least(m, reverse(translate(m, 'ACGT', 'TGCA'))) AS c FROM rm),
h AS (SELECT id, unitig, r_at, u_at, (rc.m = rc.c) = (uc.m = uc.c) AS same FROM rc JOIN uc USING (c)),
l AS (SELECT *, CASE WHEN same THEN u_at - r_at ELSE u_at + r_at END AS line FROM h),
n AS (SELECT *, r_at - row_number() OVER (PARTITION BY id, unitig, same, line ORDER BY r_at) AS run FROM l)""".replace("{seq}", SEQ)


@query(f"""WITH {_UNITS} SELECT id, unitig, CASE WHEN same THEN 'F' ELSE 'R' END AS direction, min(r_at) AS read_at, min(u_at) AS unitig_at,
  count(*) AS kmers FROM n GROUP BY id, unitig, same, line, run""")
def read_unitig_matches(s, d):
    """Runs of k-mers that reads share with unitigs, here parts of some sequences."""
    x = sequences(s, d)
    u = x.filter("id % 4 = 0 and length(seq) >= 60").select(F.col("id").alias("unitig"), F.substring("seq", 20, 30).alias("seq"))
    got = unitigs.read_matches(x, u, 15)
    return got.select("id", "unitig", "direction", F.col("read_at").cast("long").alias("read_at"), F.col("unitig_at").cast("long").alias("unitig_at"), "kmers")


@query("""WITH p AS (SELECT l_orderkey * 8 + l_linenumber AS read, l_suppkey AS super, l_quantity::BIGINT AS off,
  CASE WHEN l_linenumber % 2 = 0 THEN 'F' ELSE 'R' END AS dir FROM lineitem),
m AS (SELECT s_suppkey AS super, s_suppkey // 3 * 3 + 1 AS container,
  CASE WHEN s_suppkey % 2 = 0 THEN 'F' ELSE 'R' END AS turn, 100 + s_suppkey AS shift FROM supplier WHERE s_suppkey % 3 = 2),
x AS (SELECT read, coalesce(container, p.super) AS super, CASE WHEN turn = 'R' THEN shift - off WHEN turn = 'F' THEN off + shift ELSE off END AS off,
  CASE WHEN turn = 'R' THEN translate(dir, 'FR', 'RF') ELSE dir END AS dir FROM p LEFT JOIN m USING (super))
SELECT read, super, off AS "offset", dir AS direction FROM x WHERE super % 3 <> 0""")
def placements_moved(s, d):
    """Placements of reads after super-reads went into others; those on super-reads that are no good go."""
    x, sup = table(s, d, "lineitem"), table(s, d, "supplier")
    p = x.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("read"), F.col("l_suppkey").alias("super"),
        F.col("l_quantity").cast("long").alias("offset"), F.when(F.col("l_linenumber") % 2 == 0, "F").otherwise("R").alias("direction"))
    key = F.col("s_suppkey")
    cuts = sup.filter("s_suppkey % 3 = 2").select(key.alias("super"), (F.floor(key / 3) * 3 + 1).alias("container"),
        F.when(key % 2 == 0, "F").otherwise("R").alias("direction"), (key + 100).alias("shift"))
    return graph.moved_placements(p, cuts, sup.filter("s_suppkey % 3 <> 0").select(key.alias("super")))


@query("""WITH u AS (SELECT n_nationkey AS n, substr('ACGTTGCAAGGCTCATTCGA', n_nationkey % 8 + 1, 9) AS s FROM nation),
  p AS (SELECT o_orderkey AS id, [o_custkey % 25, o_orderkey % 25, (o_custkey + 7) % 25] AS us FROM orders),
q AS (SELECT id, k, CASE WHEN k % 2 = 0 THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END AS s FROM p, unnest([1, 2, 3]) AS t(k) JOIN u ON u.n = us[k])
SELECT id, string_agg(CASE WHEN k = 1 THEN s ELSE substr(s, 4) END, '' ORDER BY k) AS seq FROM q GROUP BY id""")
def path_sequences(s, d):
    """Sequences of paths over unitigs that share three bases with the next."""
    n = F.col("n_nationkey")
    u = table(s, d, "nation").select(n.cast("string").alias("unitig"), F.substring(F.lit("ACGTTGCAAGGCTCATTCGA"), (n % 8 + 1).cast("int"), F.lit(9)).alias("seq"))
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    path = F.array(F.concat(c % 25, F.lit("F")), F.concat(o % 25, F.lit("R")), F.concat((c + 7) % 25, F.lit("F")))
    return graph.path_sequences(table(s, d, "orders").select(o.alias("id"), path.alias("path")), u, 4)


# --- variants and positions ------------------------------------------------------------------

_VARIANTS = """v AS (SELECT l_returnflag AS file, 'c' || l_linenumber AS chrom, l_partkey AS pos, 'A' AS ref, [['C'], ['G'], ['AT'], ['C', 'G'], ['AGG']][l_suppkey % 5 + 1] AS alts, l_suppkey % 5 AS kind, l_orderkey
  FROM lineitem)"""


def _variants(s, d):
    alts = F.get(F.array(*(F.array(*map(F.lit, a)) for a in (["C"], ["G"], ["AT"], ["C", "G"], ["AGG"]))), (F.col("l_suppkey") % 5).cast("int"))
    return table(s, d, "lineitem").select(F.col("l_returnflag").alias("file"), F.concat(F.lit("c"),
        "l_linenumber").alias("chrom"), F.col("l_partkey").alias("pos"), F.lit("A").alias("ref"), alts.alias("alts"))


@query(f"""WITH {_VARIANTS}, k AS (SELECT *, CASE WHEN kind IN (2, 4) THEN 'indel' ELSE 'snp' END AS key, 'A,' || array_to_string(alts, ',') AS alleles FROM v),
f AS (SELECT chrom, pos, key, alleles, count(DISTINCT file) AS files FROM k GROUP BY ALL), n AS (SELECT k.*,
  row_number() OVER (PARTITION BY chrom, pos, key, file ORDER BY files DESC, alleles) AS nth FROM k JOIN f USING (chrom, pos, key, alleles))
SELECT chrom, pos, key, nth::INT AS nth, string_agg(file || ':' || array_to_string(alts, '/'), ' ' ORDER BY file, ref, alts) AS members FROM n
  GROUP BY chrom, pos, key, nth""")
def site_sync_both(s, d):
    """Records of several inputs side by side; substitutions go together, and so do insertions and deletions."""
    got = variants.site_sync(_variants(s, d), "both")
    members = F.array_join(F.transform("members", lambda m: F.concat(m["file"], F.lit(":"), F.array_join(m["alts"], "/"))), " ")
    return got.select("chrom", "pos", "key", "nth", members.alias("members"))


@query(f"""WITH {_VARIANTS}, a AS (SELECT chrom, pos, 'A>' || unnest(alts) AS allele, file FROM v)
  SELECT chrom, pos, allele, string_agg(DISTINCT file, ',' ORDER BY file) AS files FROM a GROUP BY chrom, pos, allele""")
def site_sync_some(s, d):
    """The inputs that have each alternative of a site."""
    got = variants.sharing_sites(_variants(s, d))
    return got.select("chrom", "pos", "allele", F.array_join("files", ",").alias("files"))


@query("""WITH h AS (SELECT DISTINCT l_returnflag AS file, l_suppkey AS ord, 'INFO' AS kind, 'ID' || l_suppkey % 13 AS id, 'x' || l_suppkey || l_returnflag || ',Type=Integer' AS text
  FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file, ord) AS k FROM h) SELECT kind, id,
  row_number() OVER (ORDER BY file, ord) AS place, text FROM f WHERE k = 1""")
def header_union(s, d):
    """Definitions of several headers as one, in the order in which they come up."""
    sup, flag = F.col("l_suppkey"), F.col("l_returnflag")
    x = table(s, d, "lineitem").select(flag.alias("file"), sup.alias("ord"), F.lit("INFO").alias("kind"), F.concat(F.lit("ID"),
        sup % 13).alias("id"), F.concat(F.lit("x"), sup, flag, F.lit(",Type=Integer")).alias("text"))
    return variants.header_union(x.distinct())


@query("""SELECT l_orderkey, l_linenumber, [l_shipmode_, l_flag_] AS samples, nullif(l_linenumber + 10, 13)::INT AS contig
  FROM (SELECT l_orderkey, l_linenumber, l_partkey::VARCHAR AS l_shipmode_, l_returnflag AS l_flag_ FROM lineitem)""")
def samples_subset(s, d):
    """Variants with some samples, in an order of their own, and contig numbers of another header."""
    x = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_returnflag"), F.lit("x"),
        F.col("l_partkey").cast("string")).alias("samples"), F.col("l_linenumber").alias("contig"))
    got = variants.sample_subset(x, ["f", "g", "p"], ["p", "f"])
    return variants.translated(got, "contig", {k: k + 10 for k in range(1, 8) if k != 3})


_READS = IV + """,
  rd AS (SELECT id, id // 2 AS name, contig % 10 AS contig, "start" % 40 AS "start", substr('ACGTTGCAAG', 1 + (id % 5)::INT, 6) AS seq, (id * 7 % 30 + 5)::INT AS q
  FROM iv),
pb AS (SELECT id, name, contig, "start", "start" + i AS pos, substr(seq, i + 1, 1) AS base, q + i AS qual FROM rd, unnest(range(0, 6)) AS t(i)),
pk AS (SELECT *, row_number() OVER (PARTITION BY contig, pos ORDER BY "start", id) AS k FROM pb), pd AS (SELECT * FROM pk WHERE k <= 50),
pm AS (SELECT *, row_number() OVER w AS m, count(*) OVER v AS n, min(base) OVER v = max(base) OVER v AS agree, sum(qual) OVER v AS total
  FROM pd WINDOW w AS (PARTITION BY contig, pos, name ORDER BY qual DESC, "start", id), v AS (PARTITION BY contig, pos, name))"""


def _bases(s, d):
    i = F.col("id")
    q = (i * 7 % 30 + 5).cast("int")
    return iv(s, d).select("id", F.floor(i / 2).alias("name"), (F.col("contig") % 10).alias("contig"), (F.col("start") % 40).alias("start"),
                           F.substring(F.lit("ACGTTGCAAG"), (1 + i % 5).cast("int"), F.lit(6)).alias("seq"),
                               F.transform(F.sequence(F.lit(0), F.lit(5)), lambda n: q + n).alias("quals"))


@query(f"""WITH {_READS} SELECT contig, pos, id, base,
  CASE WHEN n = 1 THEN qual WHEN m > 1 THEN 0 WHEN agree THEN least(total, 200) ELSE floor(qual * 0.8) END::INT AS qual FROM pm""")
def pileup(s, d):
    """Bases over each position, at most 50 reads deep; of overlapping mates one counts."""
    return variants.pileup(_bases(s, d), depth=50)


@query(f"""WITH {_READS}, sites AS (SELECT DISTINCT c_custkey % 10 AS contig, c_nationkey + 5 AS pos FROM customer) SELECT pm.contig, pm.pos,
  count(*) AS depth, count(*) FILTER (base = 'A') AS a, count(*) FILTER (n > 1) AS mates FROM pm JOIN sites USING (contig, pos) GROUP BY ALL""")
def pileup_at_sites(s, d):
    """Depths at some positions alone: only reads over them are taken apart."""
    at = F.col("c_nationkey") + 5
    sites = table(s, d, "customer").select((F.col("c_custkey") % 10).alias("contig"), at.alias("start"), at.alias("end")).distinct()
    got = variants.pileup(_bases(s, d), sites, depth=50)
    names = _bases(s, d).select("id", "name")
    per = got.join(names, "id").groupBy("contig", "pos", "name").agg(F.count("*").alias("n"), F.count_if(F.col("base") == "A").alias("a"))
    return per.groupBy("contig", "pos").agg(F.sum("n").alias("depth"), F.sum("a").alias("a"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("mates"))


# --- functions -------------------------------------------------------------------------------


@query(f"WITH {IV} SELECT id, abs(\"start\" % 1000 - \"end\" % 1000) <= 300 AS near_ends FROM iv")
def coord_matches(s, d):
    """Ends that agree within a fuzz."""
    a, b = F.col("start") % 1000, F.col("end") % 1000
    return iv(s, d).select("id", coord_match(a, a, b, b, 300).alias("near_ends"))


@query(f"""WITH {SEQ}, x AS (SELECT id, substr(seq, 3, 10) || substr(seq, 21, 15) AS t FROM seqs WHERE length(seq) >= 40) SELECT id,
  CASE WHEN id % 2 = 0 THEN reverse(translate(t, 'ACGT', 'TGCA')) ELSE t END AS seq FROM x""")
def spliced_sequences(s, d):
    """Two exons of each sequence in reading direction."""
    e = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((3, 12), (21, 35))))
    x = sequences(s, d).filter("length(seq) >= 40")
    return x.select("id", spliced(F.col("seq"), e, F.when(F.col("id") % 2 == 0, "-").otherwise("+")).alias("seq"))


@query(f"""WITH {SEQ}
  SELECT id, reverse(translate(substr(seq, 1, 30), 'ACGT', 'TGCA')) AS seq, reverse(substr(seq, 1, 30)) AS qual, substr(seq, 1, 10) || chr(10) || substr(seq, 11, 10) AS body
  FROM seqs WHERE length(seq) >= 30""")
def reads_turned(s, d):
    """Reads from the other strand, their qualities turned with them, and lines of ten."""
    x = sequences(s, d).filter("length(seq) >= 30").withColumn("s", F.substring("seq", 1, 30))
    return x.select("id", revcomp(F.col("s")).alias("seq"), F.reverse("s").alias("qual"), reformat(F.substring("s", 1, 20), 10).alias("body"))


@query("""SELECT p_size, round(lgamma(p_size / 3.0::DOUBLE), 8) AS lg, round(exp(-(p_size / 10.0::DOUBLE)), 8) AS q1,
  round(exp(-(p_size / 10.0::DOUBLE)) * (1 + p_size / 10.0::DOUBLE), 8) AS q2, round((p_size / 60.0::DOUBLE) ** 3, 8) AS beta31 FROM part
  GROUP BY p_size""")
def special_functions(s, d):
    """Log-gamma, upper incomplete gamma at whole orders and incomplete beta, where closed forms are known."""
    x = table(s, d, "part").select("p_size").distinct()
    z = (F.col("p_size") / 10).cast("double")
    return x.select("p_size", F.round(stats.log_gamma(F.col("p_size") / 3), 8).alias("lg"), F.round(stats.gamma_q(F.lit(1.0),
        z), 8).alias("q1"), F.round(stats.gamma_q(F.lit(2.0), z), 8).alias("q2"), F.round(stats.beta_i(F.lit(3.0), F.lit(1.0),
        F.col("p_size") / 60), 8).alias("beta31"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def hashes(s, d):
    """Digests of texts; hashes of 32 and 64 bits that only Spark has are beside them in the operators."""
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, ['GT:DP', 'DP:GT:AD', 'AD'][l_linenumber % 3 + 1] AS layout, ['0/1:' || l_partkey, l_partkey || ':1/1', '3'][l_linenumber % 3 + 1] AS sample FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN '0/1' WHEN 1 THEN '1/1' END AS gt, CASE WHEN l_linenumber % 3 < 2 THEN l_partkey::VARCHAR END AS dp, 'new' AS a, NULL::VARCHAR AS b, l_partkey::VARCHAR AS c FROM x""")
def fields_updated(s, d):
    """Fields of samples by their layout; entries of a map put in, replaced and taken out."""
    x, line, part = table(s, d, "lineitem"), F.col("l_linenumber"), F.col("l_partkey").cast("string")
    sample = F.get(F.array(F.concat(F.lit("0/1:"), part), F.concat(part, F.lit(":1/1")), F.lit("3")), (line % 3).cast("int"))
    layout = _of(line % 3, "GT:DP", "DP:GT:AD", "AD")
    entries = F.create_map(F.lit("A"), F.lit("old"), F.lit("B"), F.lit("gone"), F.lit("C"), part)
    now = without_entries(with_entry(entries, "A", F.lit("new")), "B")
    of = lambda k: F.try_element_at(now, F.lit(k))
    return x.select(
        "l_orderkey", "l_linenumber", sample_field(layout, sample, "GT").alias("gt"), sample_field(layout, sample, "DP").alias("dp"),
        of("A").alias("a"), of("B").alias("b"), of("C").alias("c"),
    )


@query("""WITH p AS (SELECT user_id % 20 AS contig, ts, event_id FROM events), f AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) <= 200 THEN 0 ELSE 1 END AS fresh FROM p WINDOW w AS (PARTITION BY contig ORDER BY ts, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT contig, count(*) AS n, min(floor(epoch(ts)))::BIGINT AS first_, max(floor(epoch(ts)))::BIGINT AS last_ FROM g GROUP BY contig, k""")
def session_bundles(s, d):
    """The bundles of a stream of points, taken as a batch: sessions that a gap of 200 seconds ends."""
    got = stream_bundles(table(s, d, "events").select((F.col("user_id") % 20).alias("contig"), "ts"), 200)
    return got.select("contig", "n", seconds(F.col("first")).alias("first_"), seconds(F.col("last")).alias("last_"))


@query(f"""WITH {K5}, r AS (SELECT id, substr(substr(seq, 1, 30), i, 5) AS m FROM seqs, unnest(range(1, least(length(seq), 30) - 3)) AS u(i)),
c AS (SELECT id, least(m, reverse(translate(m, 'ACGT', 'TGCA'))) AS mer FROM r) SELECT id, mer, count(*) AS n, max(coalesce("count", 0)) AS "count" FROM c LEFT JOIN kc USING (mer) GROUP BY id, mer""")
def mer_lookup(s, d):
    """The first k-mers of reads, as a stream would ask for them, with their counts."""
    x = sequences(s, d)
    got = stream_lookup(x.select("id", F.substring("seq", 1, 30).alias("seq")), kmers.count_kmers(x, 5), 5)
    return got.groupBy("id", "mer").agg(F.count("*").alias("n"), F.max("count").alias("count"))
