"""Queries of text formats: lines are made from the driver's tables, then read or written by the formats."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sam
from ..functions.filterlang import compile_filter
from ..functions.intervals import parse_region
from ..functions.text import ensembl_id, percent_decode, reduce_attrs
from ..functions.variants import trimmed_alleles
from ..operators import kmers, records, stored
from ..sources import bam, indexed, readers, writers
from .adapters import IV, SEQ, iv, sequences, table
from .registry import query
from .structure import DENSE, dense


def _tabs(*cols: Column | str | int) -> Column:
    return F.concat_ws("\t", *(c.cast("string") if isinstance(c, Column) else F.lit(str(c)) for c in cols))


def _lines(df: DataFrame, *cols: Column | str | int) -> DataFrame:
    return df.select(_tabs(*cols).alias("value"))


# --- readers ---------------------------------------------------------------------------------

#: Spliced alignments of several shapes: matches, deletions, insertions, introns and clips by the id.
_CIGARS = ("20M", "5S15M", "10M100N10M", "8M2D8M50N6M3S", "4M3I12M", "3H6M1000N6M20N6M", "*")
_SHAPES = {  # fixed by the list above: reference length, query length, blocks as (offset, length)
    "20M": (20, 20, [(0, 20)]), "5S15M": (15, 20, [(0, 15)]), "10M100N10M": (120, 20, [(0, 10), (110, 10)]), "8M2D8M50N6M3S": (74, 25, [(0, 18), (68, 6)]),
    "4M3I12M": (16, 19, [(0, 16)]), "3H6M1000N6M20N6M": (1038, 18, [(0, 6), (1006, 6), (1032, 6)]), "*": (1, 0, []),
}
_SHAPE_SQL = "(VALUES " + ", ".join(f"({k}, '{c}', {_SHAPES[c][0]}, {_SHAPES[c][1]}, {[b for b, _ in _SHAPES[c][2]]}::BIGINT[], {[n for _, n in _SHAPES[c][2]]}::BIGINT[])" for k,
    c in enumerate(_CIGARS)) + ") AS shapes(k, cigar, rlen, qlen, offs, lens)"


def _alignments(s, d) -> DataFrame:
    """events as lines of alignments."""
    i = F.col("id")
    cigar = F.get(F.array(*map(F.lit, _CIGARS)), (i % 7).cast("int"))
    tags = F.concat(F.when(i % 4 > 0, F.concat(F.lit("\tNH:i:"), (i % 4).cast("string"))).otherwise(""),
        F.when(i % 3 == 0, "\tXS:A:+").when(i % 3 == 1, "\tts:A:-").otherwise(""), F.lit("\tZZ:Z:x:y"))
    line = F.concat(_tabs(F.concat(F.lit("r"), i), F.col("flag"), F.concat(F.lit("chr"),
        F.col("contig")), F.col("start"), i % 61, cigar, "*", 0, 0, "ACGT", "IIII"), tags)
    return iv(s, d).select(line.alias("value")).unionByName(table(s, d, "nation").select(_tabs("@CO", F.col("n_name")).alias("value")))


_STRAND = "CASE WHEN id % 3 = 0 THEN '+' WHEN id % 3 = 1 THEN CASE WHEN flag & 16 <> 0 THEN '+' ELSE '-' END ELSE '.' END"


@query(f"""WITH {IV}
  SELECT 'r' || id AS qname, flag, 'chr' || contig AS contig, "start" AS pos, (id % 61)::INT AS mapq, cigar, greatest(id % 4, 1)::INT AS nh, "start" + rlen - 1 AS last, len(offs)::INT AS n_exons,
  coalesce("start" + offs[len(offs)], 0)::BIGINT AS last_exon, coalesce(list_sum(lens), 0)::BIGINT AS bases, {_STRAND} AS strand
  FROM iv JOIN {_SHAPE_SQL} ON k = id % 7""")
def sam_records(s, d):
    """Alignment lines with their blocks, ends, strands and numbers of hits."""
    x = readers.parse_sam(_alignments(s, d))
    bases = F.aggregate("exons", F.lit(0).cast("long"), lambda a, e: a + e["end"] - e["start"] + 1)
    last = F.coalesce(F.try_element_at("exons", F.lit(-1))["start"], F.lit(0).cast("long"))
    return x.select("qname", "flag", "contig", F.col("start").alias("pos"), "mapq", "cigar", "nh", F.col("end").alias("last"),
        F.size("exons").alias("n_exons"), last.alias("last_exon"), bases.alias("bases"), "strand")


@query(f"""WITH {IV} SELECT id, cigar, rlen::BIGINT AS ref_len, qlen::BIGINT AS query_len, CASE WHEN cigar = '5S15M' THEN 5 ELSE 0 END AS clip_left,
  CASE WHEN cigar LIKE '%3S' THEN 3 ELSE 0 END AS clip_right FROM iv JOIN {_SHAPE_SQL} ON k = id % 7 WHERE cigar <> '*'""")
def cigar_fields(s, d):
    """Lengths on the reference and in the read, and clipped ends."""
    c = F.get(F.array(*map(F.lit, _CIGARS)), (F.col("id") % 7).cast("int"))
    x = iv(s, d).select("id", c.alias("cigar")).filter("cigar <> '*'")
    clip = sam.clips(F.col("cigar"))
    return x.select("id", "cigar", sam.ref_len(F.col("cigar")).alias("ref_len"), sam.query_len(F.col("cigar")).alias("query_len"),
        clip["left"].alias("clip_left"), clip["right"].alias("clip_right"))


@query(f"""WITH {IV} SELECT 'r' || id AS qname FROM iv JOIN {_SHAPE_SQL} ON k = id % 7
  WHERE flag & 4 = 0 AND \"start\" >= 1 AND coalesce(list_sum(lens), 0) >= 16""")
def valid_mappings(s, d):
    """Mapped alignments with a place and at least 16 bases on the reference."""
    x = readers.parse_sam(_alignments(s, d))
    return sam.valid(x, 16).select("qname")


@query("SELECT 'chr' || n_nationkey AS contig, 1000 + n_nationkey * 7 AS length, n_name AS assembly FROM nation")
def sam_header(s, d):
    """The dictionary of an alignment header."""
    n = table(s, d, "nation")
    rows = n.select(_tabs("@SQ", F.concat(F.lit("SN:chr"), "n_nationkey"), F.concat(F.lit("LN:"),
        F.col("n_nationkey") * 7 + 1000), F.concat(F.lit("AS:"), "n_name")).alias("value"))
    x = readers.header_sequences(rows.unionByName(n.select(_tabs("@HD", F.concat(F.lit("VN:"), "n_nationkey")).alias("value"))))
    return x.select("contig", "length", F.element_at("tags", "AS").alias("assembly"))


@query("""SELECT l_partkey AS super, min(length(repeat('A', (l_quantity::INT % 9 + 1)::INT)))::BIGINT AS size FROM lineitem
  WHERE (l_orderkey * 37 % 4096) & 2308 = 0 GROUP BY l_partkey""")
def super_read_scan(s, d):
    """Super-reads from alignments that are mapped and primary, each once."""
    x = table(s, d, "lineitem").select(F.col("l_partkey").cast("string").alias("qname"), (F.col("l_orderkey") * 37 % 4096).cast("int").alias("flag"),
        F.repeat(F.lit("A"), F.col("l_quantity").cast("int") % 9 + 1).alias("seq"))
    return readers.super_reads(x)


@query("""SELECT p_partkey AS id, 'src' AS source,
  CASE WHEN p_size % 2 = 0 THEN 'exon' ELSE 'CDS' END AS feature, p_size::BIGINT AS f_start, p_size::BIGINT + 10 AS f_end,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size + 0.5 END::DOUBLE AS score,
  't' || p_partkey AS transcript, CASE WHEN p_size % 2 = 0 THEN 'g' || p_size END AS gene, p_brand AS brand FROM part""")
def gff_records(s, d):
    """Annotation lines of both dialects, told apart line by line."""
    x, two = table(s, d, "part"), F.col("p_size") % 2 == 0
    gtf = F.concat(F.lit('gene_id "g'), "p_size", F.lit('"; transcript_id "t'), "p_partkey", F.lit('"; brand "'), "p_brand", F.lit('";'))
    gff3 = F.concat(F.lit("Parent=t"), "p_partkey", F.lit(";brand="), "p_brand")
    score = F.when(F.col("p_size") % 3 == 0, ".").otherwise((F.col("p_size") + 0.5).cast("string"))
    rows = _lines(x, F.concat(F.lit("c"), "p_partkey"), "src", F.when(two,
        "exon").otherwise("CDS"), F.col("p_size"), F.col("p_size") + 10, score, "+", ".", F.when(two, gtf).otherwise(gff3))
    got = readers.parse_gff(rows)
    return got.select(F.substring("contig", 2, 20).cast("long").alias("id"), "source", "feature", F.col("start").alias("f_start"),
        F.col("end").alias("f_end"), "score", F.col("transcript_id").alias("transcript"), F.col("gene_id").alias("gene"),
        F.element_at("attrs", "brand").alias("brand"))


@query(f"WITH {DENSE} SELECT tx, len(x)::INT AS n_exons, s AS tx_start, x[len(x)].s AS last_start, s + 3 AS cds_start, e - 3 AS cds_end FROM dt")
def tlf_records(s, d):
    """Transcript lines written and read again."""
    tx = dense(s, d).select(F.col("tx").cast("string").alias("transcript_id"), F.lit("g;1").alias("gene_id"), "contig", "strand", "start", "end",
        "exons", (F.col("start") + 3).alias("cds_start"), (F.col("end") - 3).alias("cds_end"))
    got = readers.parse_tlf(writers.tlf(tx))
    return got.select(F.col("transcript_id").cast("long").alias("tx"), F.size("exons").alias("n_exons"), F.col("start").alias("tx_start"),
        F.element_at("exons", -1)["start"].alias("last_start"), "cds_start", "cds_end")


@query(f"WITH {DENSE} SELECT tx, len(x)::INT AS n_exons, s AS tx_start, e AS tx_end, x[len(x)].s AS last_start, x[1].e AS first_end, strand FROM dt")
def bed_records(s, d):
    """BED lines written and read again; starts there are counted from 0."""
    got = readers.parse_bed(writers.bed12(dense(s, d).withColumn("transcript_id", F.col("tx"))))
    return got.select(F.col("name").cast("long").alias("tx"), F.size("exons").alias("n_exons"), F.col("start").alias("tx_start"),
        F.col("end").alias("tx_end"), F.element_at("exons", -1)["start"].alias("last_start"), F.element_at("exons", 1)["end"].alias("first_end"),
        "strand")


@query("""SELECT o_orderkey AS id, o_orderkey % 50 + 1 AS bed_start, o_orderkey % 50 + 10 AS bed_end, o_orderstatus AS status, o_orderpriority AS priority
  FROM orders""")
def bed_attributes(s, d):
    """BED lines with attributes in a 13th column."""
    at = F.col("o_orderkey") % 50
    x = _lines(table(s, d, "orders"), "c", at, at + 10, F.col("o_orderkey"), 0, "+", 0, 0, 0, 1, "10", "0",
        F.concat(F.lit("status="), "o_orderstatus", F.lit(";priority="), "o_orderpriority"))
    got = readers.parse_bed(x)
    return got.select(F.col("name").cast("long").alias("id"), F.col("start").alias("bed_start"), F.col("end").alias("bed_end"),
        F.element_at("attrs", "status").alias("status"), F.element_at("attrs", "priority").alias("priority"))


@query("SELECT doc_id AS id, source, md5(regexp_replace(upper(text), '[^ACGT]', '', 'g')) AS seq_md5 FROM documents")
def fasta_records(s, d):
    """Sequence records of several lines."""
    x = sequences(s, d).join(table(s, d, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    rows = writers.fasta(x.select(F.concat("id", F.lit(" "), "source").alias("name"), "seq"), 70)
    got = readers.parse_fasta(rows)
    return got.select(F.col("name").cast("long").alias("id"), F.substring_index("header", " ", -1).alias("source"), F.md5("seq").alias("seq_md5"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS pos, substr('ACGT', 1 + l_partkey % 4, 1) AS ref,
  CASE WHEN l_suppkey % 5 = 0 THEN [] WHEN l_suppkey % 2 = 0 THEN ['G', 'T'] ELSE ['C'] END AS alts,
  CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_quantity::DOUBLE END AS qual,
  CASE WHEN l_suppkey % 7 = 0 THEN l_partkey::VARCHAR END AS depth, l_suppkey % 4 = 0 AS flagged FROM lineitem""")
def vcf_records(s, d):
    """Variant lines with alternatives and INFO fields."""
    x, sup = table(s, d, "lineitem"), F.col("l_suppkey")
    alts = F.when(sup % 5 == 0, ".").when(sup % 2 == 0, "G,T").otherwise("C")
    info = F.concat_ws(";", F.when(sup % 7 == 0, F.concat(F.lit("DP="), "l_partkey")), F.when(sup % 4 == 0, "FLAG"), F.lit("X=1"))
    ref = F.substring(F.lit("ACGT"), (1 + F.col("l_partkey") % 4).cast("int"), F.lit(1))
    rows = _lines(x, "c1", F.col("l_orderkey") * 10 + F.col("l_linenumber"), ".", ref, alts,
        F.when(sup % 3 == 0, ".").otherwise(F.col("l_quantity").cast("string")), "PASS", info)
    got = readers.parse_vcf(rows)
    return got.select("pos", "ref", "alts", "qual", F.try_element_at("info", F.lit("DP")).alias("depth"), F.map_contains_key("info", "FLAG").alias("flagged"))


@query("""SELECT 'chr' || c_nationkey AS contig, c_custkey AS coord, ['+', '-', '.'][c_custkey % 3 + 1] AS strand, ['TSS', 'CPAS', 'JSTART', 'JEND'][c_custkey % 4 + 1] AS type
  FROM customer""")
def point_features(s, d):
    """Point features: contig, coordinate, strand and type; an odd line would end the query."""
    of = lambda n, *v: F.get(F.array(*map(F.lit, v)), (F.col("c_custkey") % n).cast("int"))
    return readers.parse_points(_lines(table(s, d, "customer"), F.concat(F.lit("chr"), "c_nationkey"), F.col("c_custkey"), of(3, "+", "-", "."),
        of(4, "TSS", "CPAS", "JSTART", "JEND")))


@query(f"""WITH {IV}, u AS (SELECT 0 AS file_idx, id, contig, "start", "end" FROM iv WHERE id % 2 = 0 UNION ALL SELECT 1, id, contig, "start", "end"
  FROM iv WHERE id % 2 = 1) SELECT file_idx, id, row_number() OVER (PARTITION BY contig ORDER BY "start", "end", file_idx, id) AS place FROM u""")
def merged_inputs(s, d):
    """Two sorted inputs in one, tagged with their number, with the place of each row on its contig."""
    x = iv(s, d)
    got = readers.merged_inputs(x.filter("id % 2 = 0"), x.filter("id % 2 = 1"))
    return got.select("file_idx", "id", F.row_number().over(Window.partitionBy("contig").orderBy("start", "end", "file_idx", "id")).cast("long").alias("place"))


@query(f"""WITH {IV} SELECT 'r' || id AS qname, flag, 'chr' || contig AS contig, "start" % 100000 AS pos, (id % 61)::INT AS mapq, cigar,
  CASE WHEN id % 2 = 0 OR contig = 7 THEN '=' ELSE 'chr7' END AS rnext, 5::BIGINT AS pnext, (id % 300 - 150)::BIGINT AS tlen,
  repeat('ACGTN', qlen // 5) || substr('ACGTN', 1, qlen % 5) AS seq, nh::INT AS nh, CASE WHEN id % 3 = 0 THEN '+' END AS xs, 'a:b' || id AS note
  FROM iv JOIN {_SHAPE_SQL} ON k = id % 7 WHERE cigar <> '*'""")
def bam_records(s, d):
    """Alignments written to binary files and read again."""
    i = F.col("id")
    cigar = F.get(F.array(*map(F.lit, _CIGARS)), (i % 7).cast("int"))
    x = iv(s, d).withColumn("cigar", cigar).filter("cigar <> '*'").withColumn("n", sam.query_len(F.col("cigar")).cast("int"))
    seq = F.concat(F.expr("repeat('ACGTN', cast(floor(n / 5) as int))"), F.expr("substring('ACGTN', 1, n % 5)"))
    tags = F.map_filter(F.create_map(F.lit("NH"), F.col("nh").cast("string"), F.lit("XS"), F.when(i % 3 == 0,
        "+"), F.lit("ZZ"), F.concat(F.lit("a:b"), i)), lambda k, v: v.isNotNull())
    rows = x.select(
        F.concat(F.lit("r"), i).alias("qname"), "flag", F.concat(F.lit("chr"),
            "contig").alias("contig"), (F.col("start") % 100000).alias("start"), (i % 61).cast("int").alias("mapq"), "cigar",
        F.when(i % 2 == 0, "=").otherwise("chr7").alias("rnext"), F.lit(5).cast("long").alias("pnext"), (i % 300 - 150).alias("tlen"),
            seq.alias("seq"), F.lit("*").alias("qual"), tags.alias("tags"),
    )
    path = f"{stored.folder(s)}/bam-{uuid.uuid4().hex}"
    bam.write_bam(rows, path, [(f"chr{k}", 1 << 29) for k in range(20)])
    got = bam.bam(s, path)
    names = ("qname", "flag", "contig", F.col("start").alias("pos"), "mapq", "cigar",
        F.when(F.col("rnext") == "chr7", "chr7").otherwise("=").alias("rnext"), "pnext", "tlen", "seq", "nh", "xs")
    return got.select(*names, F.element_at("tags", "ZZ").alias("note"))


@query(f"""WITH {IV} SELECT id, contig FROM iv
  WHERE contig = 3 AND "end" >= 1704500000 AND "start" <= 1705500000 OR contig = 11 AND "end" >= 1704000000 AND "start" <= 1704300000""")
def region_indexed(s, d):
    """Rows of two regions out of files kept by contig and place."""
    path = f"{stored.folder(s)}/indexed-{uuid.uuid4().hex}"
    indexed.write_indexed(iv(s, d), path)
    return indexed.read_regions(s, path, (3, 1704500000, 1705500000), (11, 1704000000, 1704300000)).select("id", F.col("contig").cast("long").alias("contig"))


@query(f"WITH {SEQ}, r AS (SELECT id, 1 + id * 13 % 90 AS a, seq FROM seqs) SELECT id, substr(seq, a, 40) AS part FROM r WHERE a <= length(seq)")
def sequence_fetch(s, d):
    """Parts of sequences that are kept in chunks of 32 bases."""
    x = sequences(s, d).select(F.col("id").alias("name"), "seq")
    at = 1 + F.col("id") * 13 % 90
    want = sequences(s, d).select("id", F.col("id").alias("name"), at.alias("start"), (at + 39).alias("end"))
    return indexed.fetch(indexed.chunked(x, 32), want, 32).select("id", F.col("seq").alias("part"))


# --- writers ---------------------------------------------------------------------------------

_GTF = "'gene_id \"g' || contig || '\"; transcript_id \"' || tx || '\";'"


def _named(s, d) -> DataFrame:
    c = F.col("tx")
    return dense(s, d).select("*", c.cast("string").alias("transcript_id"), F.concat(F.lit("g"),
        "contig").alias("gene_id"), (c % 9 / 2).alias("cov"), (c % 5).cast("double").alias("fpkm"), (c % 3 / 4).alias("tpm"))


@query(f"""WITH {DENSE}
  SELECT concat_ws(chr(9), contig, 'strandline', 'transcript', s, e, 1000, strand, '.', {_GTF} || ' cov "' || format('{{:.6f}}', (tx % 9) / 2.0::DOUBLE) || '"; FPKM "' || format('{{:.6f}}', (tx % 5)::DOUBLE) || '"; TPM "' || format('{{:.6f}}', (tx % 3) / 4.0::DOUBLE) || '";') AS value
  FROM dt
UNION ALL SELECT concat_ws(chr(9), contig, 'strandline', 'exon', x[k].s, x[k].e, 1000, strand, '.', {_GTF} || ' exon_number "' || k || '";')
  FROM dt, unnest(range(1, len(x) + 1)) AS u(k)""")
def gtf_lines(s, d):
    """Transcripts as GTF, with coverage, FPKM and TPM on the transcript's line."""
    return writers.gtf(_named(s, d))


@query(f"""WITH {DENSE} SELECT concat_ws(chr(9), contig, 'strandline', 'transcript', s, e, '.', strand, '.', 'ID=t%3B' || tx || ';geneID=g' || contig) AS value FROM dt
UNION ALL SELECT concat_ws(chr(9), contig, 'strandline', 'exon', q.s, q.e, '.', strand, '.', 'Parent=t%3B' || tx) FROM (SELECT *, unnest(x) AS q FROM dt)""")
def gff3_lines(s, d):
    """Transcripts as GFF3; signs with a meaning are escaped."""
    return writers.gff3(_named(s, d).withColumn("transcript_id", F.concat(F.lit("t;"), "transcript_id")))


_SPANS = "array_to_string(list_transform(x, lambda q: q.s || '-' || q.e), ',')"


@query(f"""WITH {DENSE}
  SELECT concat_ws(chr(9), contig, 'strandline', 'transcript', s, e, '.', strand, '.', 'ID=' || tx || ';geneID=g' || contig || ';exonCount=' || len(x) || ';exons=' || {_SPANS}) AS value
  FROM dt""")
def tlf_lines(s, d):
    return writers.tlf(_named(s, d))


@query(f"WITH {DENSE} SELECT concat_ws(chr(9), tx, contig, s, e, strand, {_SPANS}) AS value FROM dt")
def gtab_lines(s, d):
    return writers.gtab(_named(s, d))


@query(f"""WITH {DENSE}
  SELECT tx, array_to_string(list_transform(range(1, len(x) + 1), lambda k: CASE WHEN k = 1 THEN '' ELSE (x[k].s - x[k - 1].e - 1) || 'N' END || (x[k].e - x[k].s + 1) || 'M'), '') AS cigar, strand AS xs,
  format('{{:.6f}}', (tx % 9) / 2.0::DOUBLE) || '|' || format('{{:.6f}}', (tx % 5)::DOUBLE) || '|' || format('{{:.6f}}', (tx % 3) / 4.0::DOUBLE) AS zs, ((tx % 9) / 2.0)::DOUBLE AS cov, ((tx % 3) / 4.0)::DOUBLE AS tpm
  FROM dt""")
def tx_alignments(s, d):
    """Transcripts as alignments, and their three numbers read from the tag again."""
    got = writers.as_alignments(_named(s, d).withColumn("qname", F.col("transcript_id")))
    tag = sam.coverage_tag(F.col("zs"))
    return got.select(F.col("qname").cast("long").alias("tx"), "cigar", "xs", "zs", tag["cov"].alias("cov"), tag["tpm"].alias("tpm"))


@query(f"""WITH {IV} SELECT concat_ws(chr(9), id, flag, contig, "start", 60, '10M', '*', '0', '0', '*', '*', 'XS:A:' || strand, 'NH:i:' || nh) AS value FROM iv""")
def sam_lines(s, d):
    x = iv(s, d).withColumns({"qname": F.col("id"), "mapq": F.lit(60), "cigar": F.lit("10M"), "seq": F.lit(None).cast("string"),
        "qual": F.lit(None).cast("string"), "xs": F.col("strand")})
    return writers.sam(x)


@query("SELECT 's' || s_suppkey || chr(9) || 'YK:f:' || format('{:.6f}', s_acctbal::DOUBLE) AS value FROM supplier WHERE s_suppkey % 3 > 0")
def coverage_sam_lines(s, d):
    """Lines of super-reads with their coverage as a tag; none where there is no coverage."""
    x = table(s, d, "supplier")
    rows = x.select(F.col("s_suppkey").alias("qname"), F.concat(F.lit("s"), "s_suppkey").alias("value"))
    return writers.coverage_sam(rows, x.filter("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("qname"), F.col("s_acctbal").alias("cov")))


@query("""SELECT concat_ws(chr(9), 'c' || l_suppkey, l_orderkey, '.', 'A',
  CASE WHEN l_linenumber % 2 = 0 THEN 'C,G' ELSE '.' END, '.', 'PASS', 'DP=' || l_partkey || ';END') AS value FROM lineitem""")
def vcf_lines(s, d):
    x = table(s, d, "lineitem")
    alts = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("C"), F.lit("G"))).otherwise(F.array().cast("array<string>"))
    info = F.create_map(F.lit("DP"), F.col("l_partkey").cast("string"), F.lit("END"), F.lit(None).cast("string"))
    rows = x.select(F.concat(F.lit("c"), "l_suppkey").alias("chrom"), F.col("l_orderkey").alias("pos"), F.lit(None).cast("string").alias("id"),
        F.lit("A").alias("ref"), alts.alias("alts"), F.lit(None).cast("double").alias("qual"), F.array(F.lit("PASS")).alias("filters"),
        info.alias("info"))
    return writers.vcf(rows)


@query("SELECT c_nationkey || ',' || string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS value FROM customer GROUP BY c_nationkey")
def legend_lines(s, d):
    """A line for each cluster with its members."""
    return writers.legend(table(s, d, "customer"), "c_nationkey", "c_mktsegment")


@query("""WITH q AS (SELECT regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents), m AS (SELECT substr(seq, i, 3) AS m
  FROM q, unnest(range(1, length(seq) - 1)) AS u(i)) SELECT '>' || count(*) || chr(10) || m AS value
  FROM (SELECT least(m, reverse(translate(m, 'ACGT', 'TGCA'))) AS m FROM m) GROUP BY m""")
def kmer_dump_lines(s, d):
    return writers.kmer_dump(kmers.count_kmers(sequences(s, d), 3))


@query("SELECT '@' || p_partkey || chr(10) || p_brand || chr(10) || '+' || chr(10) || repeat('I', length(p_brand)) AS value FROM part")
def fastq_lines(s, d):
    return writers.fastq(table(s, d, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_brand").alias("seq"),
        F.repeat(F.lit("I"), F.length("p_brand")).alias("qual")))


# --- fields ----------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, 'T' || p_size || CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN '.' || p_size % 5 ELSE '.7' END AS name FROM part")
def ensembl_ids(s, d):
    """Ids without the kind before them and with their version, once."""
    n = F.col("p_size")
    kind = F.get(F.array(*map(F.lit, ("gene:", "transcript:", ""))), (F.col("p_partkey") % 3).cast("int"))
    name = F.concat(kind, F.lit("T"), n, F.when(n % 3 == 2, ".7").otherwise(""))
    version = F.when(n % 3 == 1, (n % 5).cast("string")).when(n % 3 == 2, "7")
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), ensembl_id(name, version).alias("name"))


@query("SELECT p_partkey AS id, p_brand || ['.', 'prc', ' ', 'A', '%1F', '%zz', ' '][p_size % 7 + 1] || 'x%' AS text FROM part")
def percent_decoded(s, d):
    """Attribute values with %XX signs, some of which have a reading of their own."""
    code = F.get(F.array(*map(F.lit, ("%3B", "%25", "%09", "%41", "%1F", "%zz", "%C3"))), (F.col("p_size") % 7).cast("int"))
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), percent_decode(F.concat("p_brand", code, F.lit("x%"))).alias("text"))


@query("""WITH o AS (SELECT l_orderkey AS id, count(DISTINCT l_returnflag) AS n, min(l_returnflag) AS f, min(l_linestatus) AS st,
  count(DISTINCT l_linestatus) AS m FROM lineitem GROUP BY 1)
SELECT id, CASE WHEN n = 1 THEN f END AS flag, CASE WHEN m = 1 AND st <> 'F' THEN st END AS exon_status, 'F' AS status FROM o""")
def attrs_reduced(s, d):
    """Attributes that all exons share move to the transcript; where it has another value, under a name of their own."""
    exon = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus"), F.lit("exon_number"), F.lit("1"))
    x = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(exon).alias("exons"))
    got = x.select("id", reduce_attrs(F.create_map(F.lit("status"), F.lit("F")), F.col("exons")).alias("a"))
    of = lambda k: F.try_element_at("a", F.lit(k))
    return got.select("id", of("flag").alias("flag"), of("exon_status").alias("exon_status"), of("status").alias("status"))


@query("""SELECT o_orderkey AS id, 'c:' || o_orderstatus AS contig, CASE o_orderkey % 3 WHEN 0 THEN 1 ELSE o_orderkey + 1000 END::BIGINT AS r_start,
  CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey + 2000 END::BIGINT AS r_end FROM orders""")
def regions_parsed(s, d):
    """Regions as text: a contig, with a start, with both ends; commas in numbers."""
    key = F.col("o_orderkey")
    text = F.concat(F.lit("c:"), "o_orderstatus", F.when(key % 3 > 0, F.concat(F.lit(":"),
        F.format_number(key + 1000, 0))).otherwise(""), F.when(key % 3 == 2, F.concat(F.lit("-"), key + 2000)).otherwise(""))
    r = parse_region(text)
    return table(s, d, "orders").select(key.alias("id"), r["contig"].alias("contig"), r["start"].alias("r_start"), r["end"].alias("r_end"))


@query("""WITH g AS (SELECT l_orderkey AS id, list(DISTINCT nullif(l_partkey % 5, 4)
  ORDER BY nullif(l_partkey % 5, 4)) AS used, list(nullif(l_partkey % 5, 4) ORDER BY l_linenumber, l_partkey) AS gt FROM lineitem GROUP BY 1),
k AS (SELECT id, gt, list_filter([0, 1, 2, 3], lambda a: a = 0 OR list_contains(used, a)) AS olds FROM g)
SELECT id, list_transform(olds, lambda a: ['A', 'C', 'G', 'T'][a + 1]) AS alleles, list_transform(gt, lambda n: CASE WHEN n IS NULL THEN -1 ELSE list_position(olds, n) - 1 END)::INT[] AS genotype
  FROM k""")
def alleles_trimmed(s, d):
    """Variants without the alternatives that no genotype has; allele numbers are given anew."""
    x = table(s, d, "lineitem")
    gt = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda r: F.nullif(r["l_partkey"] % 5, F.lit(4)).cast("int"))
    rows = x.groupBy(F.col("l_orderkey").alias("id")).agg(gt.alias("gt"))
    got = trimmed_alleles(F.array(*map(F.lit, "ACGT")), F.array("gt"))
    return rows.select("id", got["alleles"].alias("alleles"), F.transform(F.get(got["genotypes"], F.lit(0)), lambda n: F.coalesce(n, F.lit(-1))).alias("genotype"))


_TERMS = {  # expression -> DuckDB, over flag, mapq (nh), rname (gene), qname (id as text), [NM]
    "-mapq + 6 >= 3 * 1": "-nh + 6 >= 3",
    "!(flag & 0x10) && ~flag < 0": "(flag & 16) = 0",
    "flag % 7 == 3 || flag / 2 > 2000": "flag % 7 = 3 OR flag / 2 > 2000",
    "(flag ^ 5) & 7 == 4 | 0": "(xor(flag, 5) & 7) = 4",
    'rname =~ "^[[:alpha:]]+$" && qname !~ "[[:digit:]]{3}"': "regexp_matches(gene, '^[A-Za-z]+$') AND NOT regexp_matches(id::VARCHAR, '[0-9]{3}')",
    "length(qname) > 2 && min(qname) == 48": "length(id::VARCHAR) > 2 AND contains(id::VARCHAR, '0')",
    "max(qname) - avg(qname) > 2": "list_max(list_transform(string_split(id::VARCHAR, ''), lambda c: ascii(c))) - list_avg(list_transform(string_split(id::VARCHAR, ''), lambda c: ascii(c))) > 2",
        
    "exists([NM]) && default([NM], 9) < 3": "id % 4 <> 0 AND id % 5 < 3",
    "default([NM], 9) > 8 || !exists([NM])": "id % 4 = 0",
    "!([NM])": "id % 4 = 0 OR id % 5 = 0",
    "[NM] > 1 && mapq > 0": "id % 4 <> 0 AND id % 5 > 1",
    "sqrt(pow(mapq, 2)) == mapq && exp(log(mapq)) < 2.5": "nh < 2.5",
    'rname != mapq && rname >= "p"': "gene >= 'p'",
}


@query(f"WITH {IV} SELECT id, " + ", ".join(f"coalesce({sql}, false) AS t{k}" for k, sql in enumerate(_TERMS.values())) + " FROM iv")
def filter_terms(s, d):
    """The terms of the filter language, one column each; bytes, undefined tags, named classes of signs."""
    symbols = {"flag": F.col("flag"), "mapq": F.col("nh"), "rname": F.col("gene"), "qname": F.col("id").cast("string")}
    tags = {"NM": F.when(F.col("id") % 4 != 0, F.col("id") % 5)}
    return iv(s, d).select("id", *(compile_filter(text, symbols, {"rname", "qname"}, tags).alias(f"t{k}") for k, text in enumerate(_TERMS)))


@query("""SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]')), chr(10)) AS text
  FROM documents WHERE regexp_matches(text, '[0-9]')""")
def data_grep(s, d):
    """Documents with their lines that have a digit."""
    return records.grep_lines(table(s, d, "documents").select("doc_id", "text"), "text", "[0-9]")
