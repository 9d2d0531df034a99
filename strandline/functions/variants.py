"""Variant typing and genotypes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def variant_type(ref: Column, alt: Column) -> Column:
    """REF, OVERLAP, BND, OTHER, SNP, MNP, INS or DEL of one allele."""
    same = F.length(ref) == F.length(alt)
    return (
        F.when((ref == alt) | (alt == ".") | alt.isin("<*>", "<X>", "<NON_REF>"), "REF")
        .when(alt == "*", "OVERLAP")
        .when(alt.contains("[") | alt.contains("]"), "BND")
        .when(alt.startswith("<"), "OTHER")
        .when(same & (F.length(ref) == 1), "SNP")
        .when(same, F.when(F.levenshtein(ref, alt) == 1, "SNP").otherwise("MNP"))
        .when(F.length(alt) > F.length(ref), F.when(alt.startswith(ref) | alt.endswith(ref), "INS").otherwise("OTHER"))
        .otherwise(F.when(ref.startswith(alt) | ref.endswith(alt), "DEL").otherwise("OTHER"))
    )


def genotype_class(a: Column, b: Column) -> Column:
    """Of two allele numbers: HAPL where the second is null, UNKN where the first is."""
    return (
        F.when(a.isNull(), "UNKN").when(b.isNull(), "HAPL").when((a == 0) & (b == 0), "HOM_RR").when(a == b, "HOM_AA").when((a == 0) | (b == 0),
            "HET_RA").otherwise("HET_AA")
    )


def trimmed_alleles(alleles: Column, genotypes: Column) -> Column:
    """(alleles, genotypes) without the alternatives that no genotype has; allele numbers (arrays, null
    for a missing one) are given anew. The reference allele always stays."""
    used = F.array_distinct(F.flatten(genotypes))
    kept = F.filter(F.transform(alleles, lambda a, i: F.struct(i.alias("old"), a.alias("allele"))), lambda x: (x["old"] == 0) | F.exists(used, lambda u: u == x["old"]))
    olds = F.transform(kept, lambda x: x["old"])
    renumbered = F.transform(genotypes, lambda g: F.transform(g, lambda n: F.when(n.isNotNull(), (F.array_position(olds, n.cast("int")) - 1).cast("int"))))
    return F.struct(F.transform(kept, lambda x: x["allele"]).alias("alleles"), renumbered.alias("genotypes"))


def with_entry(entries: Column, key: str, value: Column) -> Column:
    """A map of INFO fields or tags with one entry put in, in place of one of that name."""
    return F.map_concat(without_entries(entries, key), F.create_map(F.lit(key), value))


def without_entries(entries: Column, *keys: str) -> Column:
    return F.map_filter(entries, lambda k, v: ~k.isin(*keys))


def sample_field(layout: Column, sample: Column, key: str) -> Column:
    """A sample's field (``0/1:12``) by its name in the layout (``GT:DP``); null where either lacks it or it is a dot."""
    at = F.nullif(F.array_position(F.split(layout, ":"), key), F.lit(0)).cast("int")
    return F.nullif(F.get(F.split(sample, ":"), at - 1), F.lit("."))
