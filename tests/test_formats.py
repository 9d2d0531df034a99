"""Readers, writers, CIGAR strings, strands and sequences on small fixtures."""

import pytest
from pyspark.sql import functions as F

from strandline.functions import sam
from strandline.functions.intervals import introns, parse_region
from strandline.functions.sequence import canonical, kmers, reformat, revcomp, spliced, translate_dna
from strandline.functions.variants import variant_type
from strandline.operators import kmers as km
from strandline.sources import readers, writers


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("cigar", "blocks"),
    [
        ("50M100N50M", [(100, 149), (250, 299)]),
        ("10S40M2I8M", [(100, 147)]),
        ("20M3D20M", [(100, 142)]),
        ("5N20M", [(105, 124)]),
        ("20M10N5I10N20M", [(100, 119), (140, 159)]),
        ("20M10N", [(100, 119)]),
    ],
)
def test_exons(spark, cigar, blocks):
    got = one(spark, sam.exons(F.lit(100), F.col("c")), c=cigar)
    assert [(b["start"], b["end"]) for b in got] == blocks


def test_cigar_lengths(spark):
    assert one(spark, sam.query_len(F.col("c")), c="10S40M2I8M") == 60
    assert one(spark, sam.end_pos(F.lit(100), F.col("c")), c="20M3D20M") == 142
    got = one(spark, sam.clips(F.col("c")), c="10S40M7S")
    assert (got["left"], got["right"]) == (10, 7)
    assert one(spark, sam.flag_names(F.col("f")), f=99) == "PAIRED,PROPER_PAIR,MREVERSE,READ1"


def test_strand(spark):
    none = F.lit(None).cast("string")
    assert one(spark, sam.splice_strand(F.lit("+x"), none, F.col("f")), f=16) == "+"
    assert one(spark, sam.splice_strand(none, F.lit("+"), F.col("f")), f=16) == "-"
    assert one(spark, sam.splice_strand(none, none, F.col("f")), f=0) == "."
    for flag, rf, fr in ((0, "-", "+"), (16, "+", "-"), (1 | 64 | 16, "+", "-"), (1 | 128 | 16, "-", "+")):
        assert one(spark, sam.library_strand(F.lit("."), F.col("f"), "rf"), f=flag) == rf
        assert one(spark, sam.library_strand(F.lit("."), F.col("f"), "fr"), f=flag) == fr


def test_sequences(spark):
    assert one(spark, revcomp(F.col("s")), s="ACGTTn") == "nAACGT"
    assert one(spark, revcomp(revcomp(F.col("s"))), s="ACCGTTA") == "ACCGTTA"
    assert one(spark, canonical(F.col("s")), s="TTG") == "CAA"
    assert one(spark, kmers(F.col("s"), 3), s="ACGT") == ["ACG", "CGT"]
    assert one(spark, kmers(F.col("s"), 5), s="ACGT") == []
    assert one(spark, translate_dna(F.col("s")), s="ATGGCNTAAT") == "MX*"
    assert one(spark, reformat(F.col("s"), 2), s="ACGTA") == "AC\nGT\nA"
    exons = F.array(F.struct(F.lit(1).alias("start"), F.lit(2).alias("end")), F.struct(F.lit(5).alias("start"), F.lit(6).alias("end")))
    assert one(spark, spliced(F.col("s"), exons, F.lit("-")), s="AACCGG") == "CCTT"
    got = one(spark, introns(exons.cast("array<struct<start:bigint,end:bigint>>")), s="")
    assert [(i["start"], i["end"]) for i in got] == [(3, 4)]


def test_region(spark):
    got = [tuple(one(spark, parse_region(F.col("r")), r=r)) for r in ("chr1:1,000-2000", "chr1", "chr1:5", "chr1:5-")]
    assert got == [("chr1", 1000, 2000), ("chr1", 1, None), ("chr1", 5, None), ("chr1", 5, None)]


@pytest.mark.parametrize(("ref", "alt", "kind"), [("A", "C", "SNP"), ("AT", "A", "DEL"), ("A", "AT", "INS"), ("AC", "GT", "MNP"), ("A", "<*>", "REF"), ("A", "*", "OVERLAP"), ("A", "]chr2:5]A", "BND"), ("A", "<DEL>", "OTHER")])
def test_variants(spark, ref, alt, kind):
    assert one(spark, variant_type(F.col("r"), F.col("a")), r=ref, a=alt) == kind


def test_nx(spark):
    sizes = spark.createDataFrame([(x,) for x in (9, 5, 3, 2, 1)], "size long")
    got = km.nx(sizes).first()
    assert (got["n10"], got["n50"], got["n90"], got["total"], got["records"]) == (9, 5, 2, 20, 5)
    assert km.nx(sizes, genome=100).first()["n50"] is None


def test_readers(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@SQ\tSN:c1\tLN:9\nr1\t16\tc1\t100\t60\t5M10N5M\t*\t0\t0\tAAAAACCCCC\t*\tNH:i:2\tXS:A:+\nr2\t0\tc1\t50\t60\t4M\t*\t0\t0\tACGT\t*\n")
    got = {r["qname"]: r for r in readers.sam(spark, str(tmp_path / "a.sam")).collect()}
    assert (got["r1"]["nh"], got["r1"]["strand"], got["r1"]["end"], len(got["r1"]["exons"])) == (2, "+", 119, 2)
    assert (got["r2"]["nh"], got["r2"]["strand"]) == (1, ".")
    (tmp_path / "a.gtf").write_text('#x\nc1\ts\texon\t1\t9\t.\t+\t.\tgene_id "g1"; transcript_id "t1";\nc1\ts\tmRNA\t1\t9\t5.5\t-\t.\tID=t2;geneID=g2\n')
    got = {r["transcript_id"]: r for r in readers.gff(spark, str(tmp_path / "a.gtf")).collect()}
    assert (got["t1"]["gene_id"], got["t1"]["score"], got["t2"]["gene_id"], got["t2"]["score"]) == ("g1", None, "g2", 5.5)
    (tmp_path / "a.bed").write_text("track x\nc1\t10\t50\tn\t0\t+\t10\t50\t0\t2\t5,10,\t0,30,\nc2\t0\t5\n")
    got = {r["contig"]: r for r in readers.bed(spark, str(tmp_path / "a.bed")).collect()}
    assert [(e["start"], e["end"]) for e in got["c1"]["exons"]] == [(11, 15), (41, 50)]
    assert (got["c2"]["start"], got["c2"]["strand"]) == (1, ".")
    (tmp_path / "a.fa").write_text(">r1 x\nACGT\nAC\n>r2\nGG\n")
    assert {(r["name"], r["seq"]) for r in readers.fasta(spark, str(tmp_path / "a.fa")).collect()} == {("r1", "ACGTAC"), ("r2", "GG")}
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\nc1\t5\t.\tA\tC,G\t30\tPASS\tDP=5;DB\tGT\t0/1\n")
    got = readers.vcf(spark, str(tmp_path / "a.vcf")).first()
    assert (got["pos"], got["id"], got["alts"], got["info"], got["samples"]) == (5, None, ["C", "G"], {"DP": "5", "DB": None}, ["0/1"])
    (tmp_path / "a.pts").write_text("c1 5 + TSS\n")
    assert tuple(readers.points(spark, str(tmp_path / "a.pts")).first()) == ("c1", 5, "+", "TSS")
    (tmp_path / "b.pts").write_text("c1 5 + WHAT\n")
    with pytest.raises(Exception, match="bad point feature"):
        readers.points(spark, str(tmp_path / "b.pts")).collect()


def test_writers(spark):
    tx = spark.createDataFrame([("t", "g", "c", "+", 1, 30, [(1, 9), (20, 30)], 1.5, 2.0, 3.0)], "transcript_id string, gene_id string, contig string, strand string, start long, end long, exons array<struct<start:bigint,end:bigint>>, cov double, fpkm double, tpm double")
    lines = [r["value"] for r in writers.gtf(tx).collect()]
    assert len(lines) == 3
    assert 'cov "1.500000"; FPKM "2.000000"; TPM "3.000000";' in lines[0]
    assert lines[2].endswith('exon_number "2";')
    assert writers.bed12(tx).first()["value"].split("\t")[10:] == ["9,11,", "0,19,"]
    seqs = spark.createDataFrame([("a", "ACGTA")], ["name", "seq"])
    assert writers.fasta(seqs, 2).first()["value"] == ">a\nAC\nGT\nA"
