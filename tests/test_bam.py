"""The binary alignment reader on files packed here by the format's public description."""

import gzip
import struct

import pytest

from strandline.sources import bam, readers

REFS = [("chr1", 5000), ("chrX", 900)]


def packed(name, flag, ref, pos, mapq, cigar, mate_ref, mate_pos, tlen, seq, qual, tags=b""):
    ops = [n << 4 | "MIDNSHP=X".index(c) for n, c in cigar]
    codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(ops), flag, len(seq), mate_ref, mate_pos, tlen) + name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops)
    body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + (bytes(q for q in qual) if qual else b"\xff" * len(seq)) + tags
    return struct.pack("<i", len(body)) + body


def whole(records):
    head = b"@HD\tVN:1.6\n"
    out = b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", len(REFS))
    for name, size in REFS:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    return out + b"".join(records)


def stored(path, data, block=40):
    """Blocks of a few bytes, so that records run over their ends, and an empty last one."""
    path.write_bytes(b"".join(gzip.compress(data[i : i + block]) for i in range(0, len(data), block)) + gzip.compress(b""))


def test_same_rows_as_the_text_reader(spark, tmp_path):
    tags = b"NHC\x02" + b"XSA-" + b"NMi" + struct.pack("<i", -1) + b"ZSZa|b\0" + b"ZBBS" + struct.pack("<IHH", 2, 7, 500) + b"ZFf" + struct.pack("<f", 0.5)
    stored(tmp_path / "a.bam", whole([packed("r1", 99, 0, 99, 60, [(5, "S"), (3, "M"), (100, "N"), (4, "M")], 0, 299, 250, "ACGTNACGTACG", [30] * 12, tags), packed("r2", 4, -1, -1, 0, [], -1, -1, 0, "", [])]))
    stored(tmp_path / "b.bam", whole([packed("r3", 16, 1, 9, 1, [(3, "M")], 0, 5, -7, "ACG", None)]))
    lines = ["r1\t99\tchr1\t100\t60\t5S3M100N4M\t=\t300\t250\tACGTNACGTACG\t" + "?" * 12 + "\tNH:i:2\tXS:A:-\tNM:i:-1", "r2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*", "r3\t16\tchrX\t10\t1\t3M\tchr1\t6\t-7\tACG\t*"]
    (tmp_path / "t.sam").write_text("@HD\tVN:1.6\n" + "\n".join(lines) + "\n")
    got, want = bam.bam(spark, [f"{tmp_path}/a.bam", f"{tmp_path}/b.bam"]), readers.sam(spark, f"{tmp_path}/t.sam")
    assert got.select(want.columns).orderBy("qname").collect() == want.orderBy("qname").collect()
    assert got.filter("qname = 'r1'").first()["tags"] == {"NH": "2", "XS": "-", "NM": "-1", "ZS": "a|b", "ZB": "S,7,500", "ZF": "0.5"}


def test_long_cigar_and_many_rows(spark, tmp_path):
    ops = [1 << 4, 2 << 4 | 3] * 3 + [1 << 4]
    tag = b"CGBI" + struct.pack(f"<I{len(ops)}I", len(ops), *ops)
    rows = [packed("long", 0, 0, 9, 60, [(4, "S"), (10, "N")], -1, -1, 0, "ACGT", None, tag)] + [packed(f"r{i}", 0, 0, i, 60, [(2, "M")], -1, -1, 0, "AC", None) for i in range(5000)]
    stored(tmp_path / "a.bam", whole(rows), 1 << 16)
    got = bam.bam(spark, f"{tmp_path}/a.bam")
    assert got.filter("qname = 'long'").first()["cigar"] == "1M2N1M2N1M2N1M"
    assert got.agg({"start": "sum"}).first()[0] == 10 + sum(range(1, 5001))


def test_broken_files(spark, tmp_path):
    stored(tmp_path / "cut.bam", whole([packed("r", 0, 0, 9, 60, [(2, "M")], -1, -1, 0, "AC", None)])[:-1])
    stored(tmp_path / "other.bam", b"text, not alignments")
    for name, why in (("cut", "within a record"), ("other", "not a binary")):
        with pytest.raises(Exception, match=why):
            bam.bam(spark, f"{tmp_path}/{name}.bam").count()
    stored(tmp_path / "none.bam", whole([]))
    assert bam.bam(spark, f"{tmp_path}/none.bam").count() == 0


def test_written_files_are_read_again(spark, tmp_path):
    tags = {"NH": "2", "XS": "-", "CO": "a text", "NM": "x"}
    rows = [("r1", 99, "chr1", 100, 60, "5S3M100N4M", "=", 300, 250, "ACGTNACGTACG", "?" * 12, tags), ("r2", 4, "*", 0, 0, "*", "*", 0, 0, "*", "*", {}), ("r3", 16, "chrX", 10, 1, "3M", "chr1", 6, -7, "ACG", "*", None), (None, 4, None, None, None, None, None, None, None, None, None, None)]
    kind = "qname string, flag int, contig string, start long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags map<string,string>"
    df = spark.createDataFrame(rows, kind)
    assert bam.write_bam(df.repartition(3), f"{tmp_path}/out", REFS) == 4
    names = kind.replace(" ", ",").split(",")
    got = {r["qname"]: r for r in bam.bam(spark, f"{tmp_path}/out").collect()}
    for want in rows[:3]:
        for name, value in zip(("qname", "flag", "contig", "start", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "tags"), want, strict=True):
            assert got[want[0]][name] == (value or {} if name == "tags" else value), (want[0], name)
    assert got["*"]["contig"] == "*"
    assert len(names) > 12
    many = spark.range(30000).selectExpr("concat('r', id) qname", "0 flag", "'chr1' contig", "id % 4000 + 1 start", "60 mapq", "'4M' cigar", "'*' rnext", "0L pnext", "0L tlen", "'ACGT' seq", "'IIII' qual")
    assert bam.write_bam(many, f"{tmp_path}/many", REFS) == 30000
    assert bam.bam(spark, f"{tmp_path}/many").selectExpr("sum(start)", "count(distinct qname)").first() == many.selectExpr("sum(start)", "count(distinct qname)").first()
    long = "1M1N" * 40000 + "1M"
    one = spark.createDataFrame([("long", 0, "chr1", 1, 9, long, "*", 0, 0, "A" * 40001, "*")], kind.rsplit(", ", 1)[0])
    bam.write_bam(one, f"{tmp_path}/long", REFS)
    assert bam.bam(spark, f"{tmp_path}/long").select("cigar").first()["cigar"] == long


def test_blocks_are_gzip(tmp_path):
    data = bytes(range(256)) * 1000
    packed_ = bam.blocks(data)
    assert gzip.decompress(packed_) == data == gzip.decompress(bam.blocks([data[:7], b"", data[7:]]))
    at = sizes = 0
    while at < len(packed_):  # each block tells its own length
        n = struct.unpack_from("<H", packed_, at + 16)[0] + 1
        sizes += struct.unpack_from("<I", packed_, at + n - 4)[0]
        at += n
    assert (at, sizes) == (len(packed_), len(data))
    assert gzip.decompress(bam.blocks(b"")) == b""
