"""Feature kinds, parents, coding chains and allele trimming on small fixtures."""

import pytest
from pyspark.sql import functions as F

from strandline.functions.variants import trimmed_alleles
from strandline.operators import hierarchy

SPANS = "array<struct<start:bigint,end:bigint>>"


def test_feature_kind(spark):
    want = {
        "five_prime_UTR": "utr", "exon": "exon", "noncoding_exon": "exon", "stop_codon": "stop_codon", "stop_codon_redefined_as_selenocysteine": "other", "start_codon": "start_codon", "CDS": "cds",
        "intron": "intron", "mRNA": "transcript", "primary_transcript": "transcript", "V_gene_segment": "gene_segment", "gene": "gene", "pseudogene": "gene", "match": "other", None: None,
    }
    rows = spark.createDataFrame([(k,) for k in want], "f string").select("f", hierarchy.feature_kind(F.col("f")).alias("kind")).collect()
    assert {r["f"]: r["kind"] for r in rows} == want


def test_exonless_and_stray_records(spark):
    tx = spark.createDataFrame([(1, 10, 50, [], False), (2, 10, 50, None, True), (3, 10, 15, [(10, 15)], True), (4, 10, 15, [(10, 15)], False), (5, 10, 20, [(10, 20)], True)], f"id long, start long, end long, exons {SPANS}, made_by_exon boolean")
    assert [[tuple(e) for e in r["exons"]] for r in hierarchy.with_exons(tx).orderBy("id").collect()][:3] == [[(10, 50)], [(10, 50)], [(10, 15)]]
    assert sorted(r["id"] for r in hierarchy.without_stray_records(tx).collect()) == [1, 2, 4, 5]


def test_resolve_parents(spark):
    at = "contig string, strand string, start long, end long"
    parents = spark.createDataFrame([("a1", "a", "x", "+", 100, 900, 1), ("a2", "a", "x", "-", 100, 900, 2), ("a3", "a", "y", ".", 100, 900, 3), ("a4", "a", "x", "+", 800, 2000, 4), ("a5", "a", "x", "+", 9_000_000, 9_000_900, 5)], f"parent string, id string, {at}, ord int")
    children = [("c1", "a", "x", "+", 150, 160, "a1"), ("c2", "a", "x", "-", 150, 160, "a2"), ("c3", "a", "y", "-", 150, 160, "a3"), ("c4", "a", "x", "+", 1000, 1100, "a4"), ("c5", "a", "x", "+", 9_000_100, 9_000_200, "a5"), ("c6", "a", "x", "+", 5000, 5100, None), ("c7", None, "x", "+", 150, 160, None), ("c8", "a", "x", None, 850, 860, "a1")]
    got = hierarchy.resolve_parents(spark.createDataFrame([c[:-1] for c in children], f"child string, parent_id string, {at}"), parents)
    assert {r["child"]: r["parent"] for r in got.collect()} == {c[0]: c[-1] for c in children}


def test_gene_segment_chains(spark):
    segments = [("g", "v1", [(100, 200), (300, 400)]), ("g", "v2", [(90, 200), (300, 400)]), ("g", "j", [(500, 560)]), ("h", "v1", [(1, 9)])]
    chains = [("g", "c1", 1, [(110, 200), (300, 350)]), ("g", "c2", 2, [(100, 200), (300, 400)]), ("g", "c3", 3, [(120, 200), (300, 310)]), ("g", "c4", 4, [(510, 530)]), ("g", "c5", 5, [(110, 190), (300, 350)]), ("h", "c1", 1, [(1, 20)])]
    got = hierarchy.gene_segment_chains(spark.createDataFrame(chains, f"gene string, chain string, ord int, cds {SPANS}"), spark.createDataFrame(segments, f"gene string, segment string, exons {SPANS}"))
    assert {(r["gene"], r["chain"]): r["segment"] for r in got.collect()} == {("g", "c1"): "v1", ("g", "c2"): "v2", ("g", "c3"): None, ("g", "c4"): "j", ("g", "c5"): None, ("h", "c1"): None}


@pytest.mark.parametrize(
    ("alleles", "genotypes", "want"),
    [
        (["A", "C", "G"], [[0, 2], [2, None]], (["A", "G"], [[0, 1], [1, None]])),
        (["A", "C"], [[1], [0, 1]], (["A", "C"], [[1], [0, 1]])),
        (["A", "C", "T"], [[None, None]], (["A"], [[None, None]])),
    ],
)
def test_trimmed_alleles(spark, alleles, genotypes, want):
    row = spark.createDataFrame([(alleles, genotypes)], "a array<string>, g array<array<int>>").select(trimmed_alleles(F.col("a"), F.col("g")).alias("x")).first()["x"]
    assert (row["alleles"], row["genotypes"]) == want
