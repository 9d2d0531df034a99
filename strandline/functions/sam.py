"""Alignment fields as column expressions: flags, CIGAR strings, strands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bits of the flag field.
FLAGS = {"paired": 1, "proper_pair": 2, "unmap": 4, "munmap": 8, "reverse": 16, "mreverse": 32, "read1": 64, "read2": 128, "secondary": 256,
    "qcfail": 512, "dup": 1024, "supplementary": 2048}


def has(flag: Column, name: str) -> Column:
    return flag.bitwiseAND(FLAGS[name]) != 0


def flag_names(flag: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*(F.when(has(flag, n), n.upper()) for n in FLAGS))), ",")


def hits(nh: Column) -> Column:
    """Number of alignments of a read; 1 where missing or 0."""
    return F.when(F.coalesce(nh, F.lit(0)) == 0, 1).otherwise(nh)


def cigar_ops(cigar: Column) -> Column:
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), 1)
    return F.transform(parts, lambda p: F.struct(F.substring(p, -1, 1).alias("op"), F.regexp_extract(p, r"^\d+", 0).cast("long").alias("len")))


def _total(cigar: Column, kinds: str) -> Column:
    return F.aggregate(cigar_ops(cigar), F.lit(0).cast("long"), lambda a, o: a + F.when(o["op"].isin(*kinds), o["len"]).otherwise(0))


def query_len(cigar: Column) -> Column:
    return _total(cigar, "MIS=X")


def ref_len(cigar: Column) -> Column:
    return _total(cigar, "MDN=X")


def end_pos(start: Column, cigar: Column) -> Column:
    """An alignment without reference length covers one base."""
    return start + F.greatest(ref_len(cigar), F.lit(1)) - 1


def exons(start: Column, cigar: Column) -> Column:
    """Exon blocks: matches and deletions extend a block, N closes it; blocks without bases are none."""
    kind = "struct<pos:bigint,open:bigint,done:array<struct<start:bigint,end:bigint>>>"
    zero = F.struct(start.cast("long").alias("pos"), start.cast("long").alias("open"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("done")).cast(kind)

    def close(a):
        return F.when(a["pos"] > a["open"], F.concat(a["done"], F.array(F.struct(a["open"].alias("start"), (a["pos"] - 1).alias("end"))))).otherwise(a["done"])

    def step(a, o):
        moved = F.struct((a["pos"] + o["len"]).alias("pos"), a["open"].alias("open"), a["done"].alias("done")).cast(kind)
        cut = F.struct((a["pos"] + o["len"]).alias("pos"), (a["pos"] + o["len"]).alias("open"), close(a).alias("done")).cast(kind)
        return F.when(o["op"] == "N", cut).when(o["op"].isin("M", "D", "=", "X"), moved).otherwise(a)

    return F.aggregate(cigar_ops(cigar), zero, step, close)


def clips(cigar: Column) -> Column:
    n = lambda p: F.coalesce(F.nullif(F.regexp_extract(cigar, p, 1), F.lit("")).cast("int"), F.lit(0))
    return F.struct(n(r"^(?:\d+H)?(\d+)S").alias("left"), n(r"(\d+)S(?:\d+H)?$").alias("right"))


def splice_strand(xs: Column, ts: Column, flag: Column) -> Column:
    """XS, else ts turned over for reverse alignments, else a dot."""
    turned = F.when(has(flag, "reverse"), F.translate(ts, "+-", "-+")).otherwise(ts)
    return F.when(F.substring(xs, 1, 1).isin("+", "-"), F.substring(xs, 1, 1)).when(F.substring(turned, 1, 1).isin("+", "-"), F.substring(turned, 1, 1)).otherwise(".")


def library_strand(strand: Column, flag: Column, kind: str) -> Column:
    """Fills a dot for stranded libraries, ``fr`` or ``rf``; unpaired reads behave like first mates."""
    second = has(flag, "paired") & has(flag, "read2")
    plus = (has(flag, "reverse") == second) if kind == "fr" else (has(flag, "reverse") != second)
    return F.when(strand != ".", strand).when(plus, "+").otherwise("-")


def coverage_tag(zs: Column) -> Column:
    """The tag cov|fpkm|tpm as numbers; -1 for what is missing."""
    parts = F.split(zs, r"\|")
    return F.struct(*(F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("double"), F.lit(-1.0)).alias(n) for i, n in enumerate(("cov", "fpkm", "tpm"), 1)))


def valid(alignments, least: int = 10):
    """Rows that are mapped, have a place and at least ``least`` bases in their exon blocks."""
    bases = F.aggregate("exons", F.lit(0).cast("long"), lambda a, e: a + e["end"] - e["start"] + 1)
    return alignments.filter(~has(F.col("flag"), "unmap") & (F.col("start") >= 1) & (bases >= least))
