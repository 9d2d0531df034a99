"""Text lines of the output formats; each function gives a DataFrame with one column ``value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the header of a gene abundance table.
ABUNDANCE = ("Gene ID", "Gene Name", "Reference", "Strand", "Start", "End", "Coverage", "FPKM", "TPM")


def _line(*cols: Column) -> Column:
    return F.concat_ws("\t", *(F.coalesce(c.cast("string"), F.lit(".")) for c in cols)).alias("value")


def _six(c: str) -> Column:
    return F.format_string("%.6f", F.col(c).cast("double"))


def gtf(tx: DataFrame, source: str = "strandline") -> DataFrame:
    """transcript_id, gene_id, contig, strand, start, end, exons, cov, fpkm, tpm -> transcript and exon lines."""
    ids = F.format_string('gene_id "%s"; transcript_id "%s";', F.col("gene_id"), F.col("transcript_id"))
    values = F.concat(ids, F.lit(' cov "'), _six("cov"), F.lit('"; FPKM "'), _six("fpkm"), F.lit('"; TPM "'), _six("tpm"), F.lit('";'))
    row = lambda kind, s, e, text: _line(F.col("contig"), F.lit(source), F.lit(kind), s, e, F.lit("1000"), F.col("strand"), F.lit("."), text)
    lines = F.concat(F.array(row("transcript", F.col("start"), F.col("end"), values)), F.transform("exons", lambda x,
        i: row("exon", x["start"], x["end"], F.concat(ids, F.format_string(' exon_number "%s";', (i + 1).cast("string"))))))
    return tx.select(F.explode(lines).alias("value"))


def _escaped(c: Column) -> Column:
    """A value of a GFF3 attribute: characters that mean something there as %XX."""
    out = c.cast("string")
    for sign, code in (("%", "%25"), (";", "%3B"), ("=", "%3D"), ("&", "%26"), (",", "%2C"), ("\t", "%09"), ("\n", "%0A")):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return out


def gff3(tx: DataFrame, source: str = "strandline") -> DataFrame:
    """transcript_id, gene_id, contig, strand, start, end, exons -> a transcript line and its exon lines."""
    name = _escaped(F.col("transcript_id"))
    own = F.concat(F.lit("ID="), name, F.lit(";geneID="), _escaped(F.col("gene_id")))
    row = lambda kind, s, e, text: _line(F.col("contig"), F.lit(source), F.lit(kind), s, e, F.lit("."), F.col("strand"), F.lit("."), text)
    lines = F.concat(F.array(row("transcript", F.col("start"), F.col("end"), own)),
        F.transform("exons", lambda x: row("exon", x["start"], x["end"], F.concat(F.lit("Parent="), name))))
    return tx.select(F.explode(lines).alias("value"))


def tlf(tx: DataFrame, source: str = "strandline") -> DataFrame:
    """One line a transcript, its exons in an attribute, its coding span (cds_start, cds_end) where there is one."""
    spans = F.array_join(F.transform("exons", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    text = F.concat(F.lit("ID="), _escaped(F.col("transcript_id")), F.lit(";geneID="), _escaped(F.col("gene_id")), F.lit(";exonCount="),
        F.size("exons").cast("string"), F.lit(";exons="), spans)
    if {"cds_start", "cds_end"} <= set(tx.columns):
        text = F.concat(text, F.coalesce(F.concat(F.lit(";CDS="), F.col("cds_start").cast("string"), F.lit(":"), F.col("cds_end").cast("string")), F.lit("")))
    return tx.select(_line(F.col("contig"), F.lit(source), F.lit("transcript"), F.col("start"), F.col("end"), F.lit("."), F.col("strand"), F.lit("."), text))


def gtab(tx: DataFrame) -> DataFrame:
    """transcript_id, contig, start, end, strand and exons in one tabulated line."""
    spans = F.array_join(F.transform("exons", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return tx.select(_line(F.col("transcript_id"), F.col("contig"), F.col("start"), F.col("end"), F.col("strand"), spans))


def bed12(tx: DataFrame) -> DataFrame:
    sizes = F.concat(F.array_join(F.transform("exons", lambda x: (x["end"] - x["start"] + 1).cast("string")), ","), F.lit(","))
    starts = F.concat(F.array_join(F.transform("exons", lambda x: (x["start"] - F.col("start")).cast("string")), ","), F.lit(","))
    return tx.select(_line(F.col("contig"), F.col("start") - 1, F.col("end"), F.col("transcript_id"), F.lit(100), F.col("strand"), F.col("start") - 1,
        F.col("start") - 1, F.lit("0,0,0"), F.size("exons"), sizes, starts))


def fasta(seqs: DataFrame, width: int = 60) -> DataFrame:
    return seqs.select(F.concat(F.lit(">"), "name", F.lit("\n"), F.regexp_replace("seq", f"(.{{{width}}})(?!$)", "$1\n")).alias("value"))


def abundance(genes: DataFrame) -> DataFrame:
    """Rows of a gene abundance table under its header's names."""
    cols = ("gene_id", "gene_name", "contig", "strand", "start", "end")
    return genes.select(*(F.col(c).alias(n) for c, n in zip(cols, ABUNDANCE, strict=False)),
        *(_six(c).alias(n) for c, n in (("cov", "Coverage"), ("fpkm", "FPKM"), ("tpm", "TPM"))))


def ballgown(path: str, t_data: DataFrame, e_data: DataFrame, i_data: DataFrame, e2t: DataFrame, i2t: DataFrame) -> None:
    """The five tables as tab-separated folders with headers."""
    for name, df in (("t_data", t_data), ("e_data", e_data), ("i_data", i_data), ("e2t", e2t), ("i2t", i2t)):
        df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(f"{path}/{name}.ctab")


def kmer_dump(counts: DataFrame) -> DataFrame:
    return counts.select(F.format_string(">%d\n%s", "count", "mer").alias("value"))


def sam(alignments: DataFrame) -> DataFrame:
    """qname, flag, contig, start, mapq, cigar, seq, qual and, where there, xs and nh."""
    tags = [F.concat(F.lit(t), F.col(c).cast("string")) for t, c in (("XS:A:", "xs"), ("NH:i:", "nh")) if c in alignments.columns]
    core = [F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in ("qname", "flag", "contig", "start", "mapq", "cigar")]
    return alignments.select(F.concat_ws("\t", *core, F.lit("*"), F.lit("0"), F.lit("0"), F.coalesce("seq", F.lit("*")),
        F.coalesce("qual", F.lit("*")), *tags).alias("value"))


def vcf(variants: DataFrame) -> DataFrame:
    info = F.array_join(F.transform(F.array_sort(F.map_entries("info")),
        lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return variants.select(_line(F.col("chrom"), F.col("pos"), F.col("id"), F.col("ref"), F.nullif(F.array_join("alts", ","),
        F.lit("")), F.col("qual"), F.array_join("filters", ";"), F.nullif(info, F.lit(""))))


def fastq(reads: DataFrame) -> DataFrame:
    return reads.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))


def legend(clusters: DataFrame, cluster: str, member: str) -> DataFrame:
    """``cluster,member|member|...``; members in order."""
    return clusters.groupBy(cluster).agg(F.array_join(F.array_sort(F.collect_set(F.col(member).cast("string"))),
        "|").alias("m")).select(F.concat_ws(",", F.col(cluster).cast("string"), "m").alias("value"))


def as_alignments(tx: DataFrame) -> DataFrame:
    """Transcripts (qname, contig, strand, exons, cov, fpkm, tpm) as alignments: M over exons and N over
    introns, the strand in XS and the three numbers in ZS."""
    gap = F.zip_with(F.slice("exons", 1, F.size("exons") - 1), F.slice("exons", 2, F.size("exons") - 1), lambda a,
        b: F.concat((b["start"] - a["end"] - 1).cast("string"), F.lit("N")))
    match = F.transform("exons", lambda e: F.concat((e["end"] - e["start"] + 1).cast("string"), F.lit("M")))
    # what stands before each exon: nothing, then the introns
    cigar = F.array_join(F.zip_with(F.concat(F.array(F.lit("")), gap), match, lambda a, b: F.concat(a, b)), "")
    return tx.select(
        "qname", F.lit(0).alias("flag"), "contig", F.element_at("exons", 1)["start"].alias("start"), F.lit(255).alias("mapq"), cigar.alias("cigar"),
            F.when(F.col("strand") != ".", F.col("strand")).alias("xs"),
        F.concat_ws("|", *(F.format_string("%.6f", F.col(c).cast("double")) for c in ("cov", "fpkm", "tpm"))).alias("zs"),
    )


def coverage_sam(alignments: DataFrame, coverage: DataFrame) -> DataFrame:
    """(qname, value) SAM lines with the coverage of their target as ``YK:f:``; none where it has no coverage."""
    return alignments.join(coverage.select("qname", "cov"), "qname").select(F.concat("value", F.lit("\tYK:f:"),
        F.format_string("%.6f", F.col("cov").cast("double"))).alias("value"))
