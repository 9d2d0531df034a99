"""Variants of several inputs: headers, samples, sites lined up, bases over positions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.variants import variant_type
from .intervals import overlap_join

#: Kinds of alternatives that a way of pairing takes for alike.
WAYS = {
    "exact": {},
    "snps": {"SNP": "snp", "MNP": "snp"},
    "indels": {"INS": "indel", "DEL": "indel"},
    "both": {"SNP": "snp", "MNP": "snp", "INS": "indel", "DEL": "indel"},
    "both_ref": {"SNP": "snp", "MNP": "snp", "INS": "indel", "DEL": "indel", "REF": "ref"},
    "any": dict.fromkeys(("SNP", "MNP", "INS", "DEL", "REF", "OTHER", "BND", "OVERLAP"), "any"),
}


def site_key(ref: Column, alts: Column, how: str = "exact") -> Column:
    """What records of one site must have in common to go together: their kind, where the way takes it for
    alike, else their alleles in order. Records of several kinds go by their alleles unless all are alike."""
    kinds = F.array_distinct(F.transform(F.when(F.size(alts) > 0, alts).otherwise(F.array(ref)), lambda a: variant_type(ref, a)))
    names = WAYS[how]
    alike = F.array_distinct(F.transform(kinds, lambda k: F.coalesce(*(F.when(k == x,
        y) for x, y in names.items()), F.concat(F.lit("="), k)) if names else F.concat(F.lit("="), k)))
    exact = F.concat(F.lit("="), F.concat_ws(",", F.array(F.upper(ref)), F.array_sort(F.transform(alts, lambda a: F.upper(a)))))
    return F.when((F.size(alike) == 1) & ~F.get(alike, F.lit(0)).startswith("="), F.get(alike, F.lit(0))).otherwise(exact)


def site_sync(variants: DataFrame, how: str = "exact") -> DataFrame:
    """(file, chrom, pos, ref, alts) -> chrom, pos, key, nth, members (file, ref, alts): rows of several inputs side by side.

    Records of one site go together by ``site_key``. Of several records of a file with one key, those
    whose alleles most files share are the first of each file, so that equal alleles meet: nth counts them.
    """
    rows = variants.withColumns({"key": site_key(F.col("ref"), F.col("alts"), how), "alleles_": F.concat_ws(",", "ref", F.array_sort("alts"))})
    site = ["chrom", "pos", "key"]
    # dealt by site once: what follows keeps to it
    rows = rows.filter("chrom is not null and pos is not null and key is not null").repartition(*site)
    shared = rows.withColumn("files_", F.size(F.collect_set("file").over(Window.partitionBy(*site, "alleles_"))))
    nth = F.row_number().over(Window.partitionBy(*site, "file").orderBy(F.desc("files_"), "alleles_"))
    placed = shared.withColumn("nth", nth)
    return placed.groupBy(*site, "nth").agg(F.array_sort(F.collect_list(F.struct("file", "ref", "alts"))).alias("members"))


def sharing_sites(variants: DataFrame) -> DataFrame:
    """(file, chrom, pos, ref, alts) -> chrom, pos, allele, files: an alternative and the inputs that have it, so
    that records go together if some of their alternatives match."""
    one = variants.select("file", "chrom", "pos", F.explode("alts").alias("alt"), F.upper("ref").alias("ref"))
    return one.groupBy("chrom", "pos", F.concat_ws(">", "ref", F.upper("alt")).alias("allele")).agg(F.array_sort(F.collect_set("file")).alias("files"))


def header_union(headers: DataFrame) -> DataFrame:
    """(file, ord, kind, id, text) -> kind, id, place, text: definitions of several headers as one.

    An id counts once in its kind, by its first text in the order of files and lines; places are the order in which
    ids come up. Two inputs that define an id with other types end the query.
    """
    of = Window.partitionBy("kind", "id").orderBy("file", "ord")
    typ = F.regexp_extract("text", r"Type=(\w+)", 1)
    first = headers.withColumns({"n_": F.row_number().over(of), "typ_": typ})
    odd = F.size(F.collect_set(F.when(F.col("typ_") != "", F.col("typ_")))) > 1
    told = F.raise_error(F.concat(F.lit("types differ: "), F.first("id"))).cast("string")
    out = first.groupBy("kind", "id").agg(F.min(F.struct("file", "ord", "text")).alias("f"), F.when(odd, told).alias("odd_"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("f.file", "f.ord"))  # a header's lines are few
    return out.filter(F.col("odd_").isNull()).select("kind", "id", place.cast("long").alias("place"), F.col("f.text").alias("text"))


def sample_subset(variants: DataFrame, names: list[str], wanted: list[str], samples: str = "samples") -> DataFrame:
    """Variants with the columns of the wanted samples alone, in that order; an unknown one is an error."""
    unknown = [x for x in wanted if x not in names]
    if unknown:
        raise ValueError(f"no such sample: {unknown[0]}")
    return variants.withColumn(samples, F.array(*(F.get(samples, F.lit(names.index(x))) for x in wanted)))


def translated(df: DataFrame, column: str, ids: Mapping[int, int]) -> DataFrame:
    """Numbers of one header as those of another; unknown ones are null."""
    table = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair]) if ids else F.create_map().cast("map<int,int>")
    return df.withColumn(column, F.try_element_at(table, F.col(column).cast("int")))


def pileup(reads: DataFrame, sites: DataFrame | None = None, depth: int = 8000, most_quality: int = 200) -> DataFrame:
    """(id, name, contig, start, seq, quals) reads without gaps -> contig, pos, id, base, qual: the bases over each position.

    Where both mates of a name cover a position, the one of higher quality (the first, of equal ones) counts: with the sum
    of both qualities, ``most_quality`` at most, if they agree, else with four fifths of its own; the other
    has quality 0. At most ``depth`` reads a position, the first by start and id: the operator's option. With
    ``sites`` (contig, start, end) only positions inside.
    """
    x = reads
    if sites is not None:
        spans = reads.select("id", "contig", "start", (F.col("start") + F.length("seq") - 1).alias("end"))
        x = reads.join(overlap_join(spans, sites).select(F.col("a_id").alias("id")).distinct(), "id", "left_semi")
    bases = x.select("id", "name", "contig", "start", F.posexplode(F.arrays_zip(F.split("seq", "").alias("base"), F.col("quals").alias("qual"))).alias("i", "b"))
    bases = bases.select("id", "name", "contig", "start", (F.col("start") + F.col("i")).alias("pos"), F.col("b.base").alias("base"),
        F.col("b.qual").cast("int").alias("qual"))
    at = Window.partitionBy("contig", "pos")
    first = bases.withColumn("k_", F.row_number().over(at.orderBy("start", "id"))).filter(F.col("k_") <= depth)
    mates = Window.partitionBy("contig", "pos", "name")
    rank = F.row_number().over(mates.orderBy(F.desc("qual"), "start", "id"))
    two = F.count("*").over(mates) > 1
    agree = F.min("base").over(mates) == F.max("base").over(mates)
    joint = F.when(agree, F.least(F.sum("qual").over(mates), F.lit(most_quality))).otherwise(F.floor(F.col("qual") * 0.8))
    qual = F.when(~two, F.col("qual")).when(rank == 1, joint).otherwise(0)
    out = first.select("contig", "pos", "id", "base", qual.cast("int").alias("qual"))
    if sites is not None:
        points = overlap_join(out.select("contig", F.col("pos").alias("start"), F.col("pos").alias("end"), "id", "base", "qual"), sites)
        out = points.select(F.col("a_contig").alias("contig"), F.col("a_start").alias("pos"), F.col("a_id").alias("id"),
            F.col("a_base").alias("base"), F.col("a_qual").alias("qual")).distinct()
    return out
