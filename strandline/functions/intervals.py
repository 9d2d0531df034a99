"""Closed 1-based intervals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column, slack: int = 0) -> Column:
    return (s1 <= e2 + slack) & (s2 <= e1 + slack)


def overlap_len(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)


def contains(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= s2) & (e2 <= e1)


def coord_match(s1: Column, e1: Column, s2: Column, e2: Column, fuzz: int = 0) -> Column:
    return (F.abs(s1 - s2) <= fuzz) & (F.abs(e1 - e2) <= fuzz)


def parse_region(region: Column) -> Column:
    """``chr``, ``chr:beg`` or ``chr:beg-end`` (commas allowed) as a struct; an open end is null."""
    shape = r"^(.*?)(?::([\d,]+)(?:-([\d,]*))?)?$"
    number = lambda k: F.nullif(F.regexp_replace(F.regexp_extract(region, shape, k), ",", ""), F.lit("")).cast("long")
    return F.struct(F.regexp_extract(region, shape, 1).alias("contig"), F.coalesce(number(2), F.lit(1)).alias("start"), number(3).alias("end"))


def introns(exons: Column) -> Column:
    """Gaps between sorted exons: (previous end + 1, next start - 1)."""
    return F.when(
        F.size(exons) > 1,
        F.zip_with(F.slice(exons, 1, F.size(exons) - 1), F.slice(exons, 2, F.size(exons) - 1), lambda a,
            b: F.struct((a["end"] + 1).alias("start"), (b["start"] - 1).alias("end"))),
    ).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def exons_len(exons: Column) -> Column:
    return F.aggregate(exons, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"] + 1)


def exon_overlap(a: Column, b: Column) -> Column:
    """Bases that the exons of two transcripts share; the exons of either do not overlap."""
    common = lambda x, y: F.greatest(F.lit(0).cast("long"), F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]) + 1)
    return F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + F.aggregate(b, F.lit(0).cast("long"), lambda k, y: k + common(x, y)))


def expand(start: Column, end: Column, by: int = 0, to_start: Column | None = None, to_end: Column | None = None) -> Column:
    """A wider interval: by bases on both sides (the start stays at 1 at least), and to hold another one."""
    s, e = F.greatest(start - by, F.lit(1)) if by else start, end + by
    if to_start is not None:
        s, e = F.least(s, to_start), F.greatest(e, to_end)
    return F.struct(s.alias("start"), e.alias("end"))


def set_cds(exons: Column, cds_start: Column, cds_end: Column, phase: Column | None = None) -> Column:
    """(start, end, phase, parts) of a coding span, its parts being what it has of the exons; null where it
    reaches beyond the transcript."""
    inside = (cds_start >= F.element_at(exons, 1)["start"]) & (cds_end <= F.element_at(exons, -1)["end"]) & (cds_start <= cds_end)
    parts = F.transform(
        F.filter(exons, lambda x: (x["start"] <= cds_end) & (cds_start <= x["end"])),
        lambda x: F.struct(F.greatest(x["start"], cds_start).alias("start"), F.least(x["end"], cds_end).alias("end")),
    )
    return F.when(inside, F.struct(cds_start.alias("start"), cds_end.alias("end"), (F.lit(0) if phase is None else phase).alias("phase"), parts.alias("parts")))
