"""Regions of stored rows, chunks of sequences, formats by first bytes, base modifications, table sizes."""

import bz2
import gzip
import lzma

from pyspark.sql import functions as F

from strandline.functions.modifications import base_modifications, modified
from strandline.operators.kmers import table_entries
from strandline.sources import bam, indexed


def test_regions_reach_the_scan(spark, tmp_path):
    rows = spark.range(2000).select((F.col("id") % 3).cast("string").alias("contig"), F.col("id").alias("start"), (F.col("id") + 10).alias("end"))
    indexed.write_indexed(rows, f"{tmp_path}/x")
    got = indexed.read_regions(spark, f"{tmp_path}/x", ("1", 500, 520), ("2", 515, 515))
    assert sorted(r["start"] for r in got.collect()) == sorted([*(i for i in range(490, 521) if i % 3 == 1), *(i for i in range(505, 516) if i % 3 == 2)])
    plan = got._jdf.queryExecution().explainString(got.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [((cast(contig" in plan or "PartitionFilters: [((contig" in plan
    assert "PushedFilters: [Or(" in plan
    assert indexed.read_regions(spark, f"{tmp_path}/x").count() == 0


def test_chunks(spark):
    seqs = spark.createDataFrame([("a", "ACGTACGTAC"), ("b", ""), ("c", None)], "name string, seq string")
    chunks = indexed.chunked(seqs, 4)
    assert sorted(map(tuple, chunks.collect())) == [("a", 0, "ACGT"), ("a", 1, "ACGT"), ("a", 2, "AC")]
    want = spark.createDataFrame([(1, "a", 3, 9), (2, "a", -5, 2), (3, "a", 9, 99), (4, "a", 11, 12), (5, "z", 1, 2), (6, "a", 4, 3)], "id long, name string, start long, end long")
    assert {r["id"]: r["seq"] for r in indexed.fetch(chunks, want, 4).collect()} == {1: "GTACGTA", 2: "AC", 3: "AC"}


def test_formats_by_first_bytes(spark, tmp_path):
    cases = {
        b"@HD\tVN:1\n": "sam", b"r\t0\tc\t5\t1\t*\t*\t0\t0\tA\tI\n": "sam", b"@r\nAC\n+\nII\n": "fastq", b">x\nAC\n": "fasta", b"##fileformat=VCFv4.2\n": "vcf", b"##gff-version 3\n": "gff3",
        b"c\ts\texon\t1\t5\t.\t+\t.\tx\n": "gtf", b"c\t1\t5\n": "bed", b"BAM\1abc": "bam", b"CRAM\3": "cram", b"words": "text", b"\0\1": "data", b"": "data",
    }
    for data, kind in cases.items():
        assert indexed.identify(data) == (kind, None), data
        for name, pack in (("gzip", gzip.compress), ("bzip2", bz2.compress), ("xz", lzma.compress), ("bgzf", bam.blocks)):
            assert indexed.identify(pack(data)) == (kind, name), (data, name)
    (tmp_path / "a").write_bytes(lzma.compress(b"@r\nAC\n+\nII\n"))
    (tmp_path / "b").write_bytes(b"c\t1\t5\n")
    assert {(r["path"][-1], r["format"], r["packing"]) for r in indexed.identified(spark, str(tmp_path)).collect()} == {("a", "fastq", "xz"), ("b", "bed", None)}


def test_base_modifications(spark):
    assert modified("ACCGC", False, "C+m,1,0;A+a?,0;", [10, 20, 30]) == [(0, "A", "+", "a", 30), (2, "C", "+", "m", 10), (4, "C", "+", "m", 20)]
    assert modified("GCGGT", True, "C+m,1,0;", [10, 20]) == [(0, "C", "+", "m", 20), (2, "C", "+", "m", 10)]
    assert modified("CC", False, "C+mh,1;C-76792,0;", [1, 2, 3]) == [(0, "C", "-", "76792", 3), (1, "C", "+", "h", 2), (1, "C", "+", "m", 1)]
    assert modified("ACC", False, "N+n.,2;", None) == [(2, "N", "+", "n", None)]
    assert modified("AC", False, "C+m,1;", [1]) is None
    assert modified("AC", False, "C?m", [1]) is None
    assert modified("AC", False, "", []) == []
    df = spark.createDataFrame([("ACCGC", False, "C+m,1;", [7]), (None, False, "C+m,1;", None), ("AC", True, None, None)], "s string, r boolean, mm string, ml array<int>")
    got = [r["x"] for r in df.select(base_modifications("s", "r", "mm", "ml").alias("x")).collect()]
    assert [tuple(got[0][0])] == [(2, "C", "+", "m", 7)]
    assert got[1:] == [None, None]


def test_table_sizes():
    assert table_entries(1000, 24, 50) == 2750
    assert table_entries(1, 1, 0) == 2
