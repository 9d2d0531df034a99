"""Read files, transcript lines, conversions and record tools."""

import gzip

import pytest
from pyspark.sql import functions as F

from strandline.functions.sam import coverage_tag, exons
from strandline.operators import records
from strandline.sources import readers, writers


@pytest.mark.parametrize("span", [17, 50, 64 << 20])
def test_fastq(spark, tmp_path, span):
    want = [(f"r{i}", "ACGT" * (i % 5 + 1), ("@+I!" * (i % 5 + 1))) for i in range(40)]
    text = "".join(f"@{n} x\n{s}\n+\n{q}\n" for n, s, q in want)
    (tmp_path / "a.fastq").write_text(text)
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(text.replace("@r", "@z"))
    (tmp_path / "c.fastq").write_text("")
    got = readers.fastq(spark, [str(tmp_path / n) for n in ("a.fastq", "b.fastq.gz", "c.fastq")], span)
    rows = sorted(tuple(r) for r in got.select("name", "seq", "qual").collect())
    assert rows == sorted([*want, *((n.replace("r", "z"), s, q) for n, s, q in want)])
    back = got.filter("name like 'r%'").orderBy("at")
    assert [r["value"] for r in writers.fastq(back).collect()] == [f"@{n}\n{s}\n+\n{q}" for n, s, q in want]


def test_transcript_lines(spark, tmp_path):
    (tmp_path / "t.tlf").write_text("c\ts\ttranscript\t1\t30\t.\t+\t.\tID=t1;exons=1-10,20-30;CDS=5:25\nc\ts\tgene\t1\t30\t.\t+\t.\tID=g1\n")
    row = readers.tlf(spark, str(tmp_path / "t.tlf")).collect()
    assert [([tuple(e) for e in r["exons"]], r["cds_start"], r["cds_end"]) for r in row] == [([(1, 10), (20, 30)], 5, 25)]


def test_conversions(spark):
    tx = spark.createDataFrame([("t", "c", "-", [(5, 14), (20, 20)], 1.5, 2.0, 3.0), ("u", "c", ".", [(1, 3)], 0.0, 0.0, 0.0)], "qname string, contig string, strand string, exons array<struct<start:bigint,end:bigint>>, cov double, fpkm double, tpm double")
    got = writers.as_alignments(tx)
    rows = got.withColumns({"back": exons(F.col("start"), F.col("cigar")), "z": coverage_tag(F.col("zs"))}).orderBy("qname").collect()
    assert [r["cigar"] for r in rows] == ["10M5N1M", "3M"]
    assert [[tuple(e) for e in r["back"]] for r in rows] == [[(5, 14), (20, 20)], [(1, 3)]]
    assert [(tuple(r["z"]), r["xs"]) for r in rows] == [((1.5, 2.0, 3.0), "-"), ((0.0, 0.0, 0.0), None)]
    assert tuple(spark.range(1).select(coverage_tag(F.lit("4")).alias("z")).first()["z"]) == (4.0, -1.0, -1.0)
    assert [r["value"] for r in writers.legend(spark.createDataFrame([(1, "b"), (1, "a")], "c long, g string"), "c", "g").collect()] == ["1,a|b"]
    sam = spark.createDataFrame([("s", "s\t0")], "qname string, value string")
    assert writers.coverage_sam(sam, spark.createDataFrame([("s", 2.0)], "qname string, cov double")).first()["value"] == "s\t0\tYK:f:2.000000"


def test_record_tools(spark):
    a, b = (spark.createDataFrame([(i, f"{n}{i}") for i in range(3)], "ord long, name string") for n in "xy")
    assert [r["name"] for r in records.interleave(a, b).orderBy("ord").collect()] == ["x0", "y0", "x1", "y1", "x2", "y2"]
    with pytest.raises(Exception, match="no mate at 2"):
        records.interleave(a, b.filter("ord < 2")).collect()
    h = spark.createDataFrame([(x,) for x in ("r10", "R2", "b", "a1.5")], ["h"])
    order = lambda how: [r["h"] for r in records.ordered(h, "h", how).collect()]
    assert order("text") == ["R2", "a1.5", "b", "r10"]
    assert order("nocase") == ["a1.5", "b", "r10", "R2"]
    assert order("number") == ["a1.5", "R2", "r10", "b"]
    assert sorted(order("random")) == sorted(order("text"))
    kept, left = (records.sample(spark.range(100), 0.3, 7, invert).count() for invert in (False, True))
    assert kept + left == 100
