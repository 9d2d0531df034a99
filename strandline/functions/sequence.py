"""DNA strings as column expressions; every function keeps to built-in expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC codes and their complements.
_CODES, _PAIRS = "ACGTUNRYKMSWBDHVacgtunrykmswbdhv", "TGCAANYRMKSWVHDBtgcaanyrmkswvhdb"
#: The standard genetic code in TCAG order.
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = dict(zip(map("".join, product("TCAG", repeat=3)), _AMINO, strict=True))


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, _CODES, _PAIRS))


def canonical(seq: Column) -> Column:
    """The lesser of a sequence and its reverse complement; case does not count, ties keep the sequence."""
    return F.when(F.upper(revcomp(seq)) < F.upper(seq), revcomp(seq)).otherwise(seq)


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in order; none where the sequence is shorter. One regular expression that looks ahead
    takes time in proportion to the length, where substrings by position would take its square."""
    return F.coalesce(F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), 1), F.array().cast("array<string>"))


def translate_dna(seq: Column) -> Column:
    """Amino acids of whole codons; X where a codon has an ambiguous base."""
    table = F.create_map(*[F.lit(x) for pair in CODONS.items() for x in pair])
    codons = F.regexp_extract_all(F.translate(F.upper(seq), "U", "T"), F.lit("(?s).{3}"), 0)
    return F.coalesce(F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), ""), F.lit(""))


def split_at_n(seq: Column, least: int = 2) -> Column:
    """Parts between runs of at least ``least`` N."""
    return F.filter(F.split(seq, f"[Nn]{{{least},}}"), lambda x: x != "")


def reformat(seq: Column, width: int) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?!$)", "$1\n")


def spliced(seq: Column, exons: Column, strand: Column) -> Column:
    joined = F.array_join(F.transform(exons, lambda e: F.substring(seq, e["start"].cast("int"), (e["end"] - e["start"] + 1).cast("int"))), "")
    return F.when(strand == "-", revcomp(joined)).otherwise(joined)


def quality_kmers(seq: Column, qual: Column, k: int, least: int, offset: int = 33) -> Column:
    """(mer, high) of every window: high where all of its bases reach the quality ``least``."""
    good = F.regexp_replace(qual, f"[^{_class(offset + least)}]", " ")
    return F.zip_with(kmers(seq, k), kmers(good, k), lambda m, g: F.struct(m.alias("mer"), (~F.contains(g, F.lit(" "))).cast("int").alias("high")))


def _class(code: int) -> str:
    return f"\\x{{{code:x}}}-\\x{{7e}}"


def to_genome(exons: Column, strand: Column, at: Column) -> Column:
    """The genome position of the 1-based place ``at`` in a spliced transcript; null outside it."""
    n = F.aggregate(exons, F.lit(0).cast("long"), lambda a, e: a + e["end"] - e["start"] + 1)
    place = F.when(strand == "-", n - at + 1).otherwise(at).cast("long")
    kind = "struct<left:bigint,pos:bigint>"

    def step(a, e):
        size = e["end"] - e["start"] + 1
        hit = a["pos"].isNull() & (a["left"] >= 1) & (a["left"] <= size)
        return F.struct((a["left"] - size).alias("left"), F.when(hit, e["start"] + a["left"] - 1).otherwise(a["pos"]).alias("pos")).cast(kind)

    return F.aggregate(exons, F.struct(place.alias("left"), F.lit(None).cast("long").alias("pos")).cast(kind), step, lambda a: a["pos"])


def to_transcript(exons: Column, strand: Column, pos: Column) -> Column:
    """The 1-based place of a genome position in a spliced transcript; null in introns and outside."""
    inside = F.exists(exons, lambda e: (e["start"] <= pos) & (pos <= e["end"]))
    before = F.aggregate(exons, F.lit(0).cast("long"), lambda a, e: a + F.greatest(F.lit(0).cast("long"), F.least(e["end"], pos.cast("long")) - e["start"] + 1))
    n = F.aggregate(exons, F.lit(0).cast("long"), lambda a, e: a + e["end"] - e["start"] + 1)
    return F.when(inside, F.when(strand == "-", n - before + 1).otherwise(before))


def exon_of(exons: Column, pos: Column) -> Column:
    """The 1-based number of the exon that holds a position, 0 for none."""
    return F.coalesce(F.array_position(F.transform(exons, lambda e: (e["start"] <= pos) & (pos <= e["end"])), True), F.lit(0))


def pad_ends(exons: Column, by: int) -> Column:
    """Widens the first and the last exon; a negative number takes that back."""
    return F.transform(exons, lambda e, i: F.struct(F.when(i == 0, e["start"] - by).otherwise(e["start"]).alias("start"),
        F.when(i == F.size(exons) - 1, e["end"] + by).otherwise(e["end"]).alias("end")))
