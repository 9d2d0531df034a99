"""Annotation hierarchies: kinds of features, parents of children, coding chains of gene segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import exons_len, introns, overlaps

#: Fixed value: the longest distance between the starts of a child and its parent.
MOST_LOCUS = 7_000_000


def feature_kind(feature: Column) -> Column:
    """utr, exon, stop_codon, start_codon, cds, intron, transcript, gene_segment, gene or other, by a
    feature's name in any case; null stays null."""
    f = F.lower(feature)
    codon = f.contains("codon") | f.contains("cds")
    return (
        F.when(f.contains("utr"), "utr")
        .when(f.endswith("exon"), "exon")
        .when(f.contains("stop") & codon & ~f.contains("redefined") & ~f.contains("selenocysteine"), "stop_codon")
        .when(f.contains("start") & codon, "start_codon")
        .when(f == "cds", "cds")
        .when(f.startswith("intron") | f.endswith("intron"), "intron")
        .when(f.endswith("rna") | f.endswith("transcript"), "transcript")
        .when(f.endswith("_gene_segment"), "gene_segment")
        .when(f.startswith("gene") | f.endswith("gene"), "gene")
        .when(f.isNotNull(), "other")
    )


def with_exons(tx: DataFrame) -> DataFrame:
    """Transcripts without exons get one over their whole span."""
    whole = F.array(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))
    return tx.withColumn("exons", F.when(F.coalesce(F.size("exons"), F.lit(0)) > 0, F.col("exons")).otherwise(whole))


def without_stray_records(tx: DataFrame, made_by_exon: str = "made_by_exon", least: int = 10) -> DataFrame:
    """Without records that a child exon alone called for and that span fewer than ``least`` + 1 bases in one exon."""
    stray = F.col(made_by_exon) & (F.col("end") - F.col("start") < least) & (F.coalesce(F.size("exons"), F.lit(0)) <= 1)
    return tx.filter(~F.coalesce(stray, F.lit(False)))


def resolve_parents(children: DataFrame, parents: DataFrame, most: int = MOST_LOCUS) -> DataFrame:
    """(child, parent_id, contig, strand, start, end) and (parent, id, contig, strand, start, end, ord):
    child, parent. An id may be used more than once: its first use by ``ord`` counts that lies on the
    same contig, on no other strand, begins within ``most`` and overlaps; null where none does.
    """
    p = parents.select("parent", "ord", F.col("id").alias("parent_id"), "contig", F.col("strand").alias("p_strand"), F.col("start").alias("p_start"),
        F.col("end").alias("p_end"))
    near = children.join(p, ["parent_id", "contig"])
    strands = (F.col("p_strand") == ".") | (F.col("strand") == F.col("p_strand")) | F.col("strand").isNull()
    fits = strands & (F.abs(F.col("start") - F.col("p_start")) <= most) & overlaps(F.col("start"), F.col("end"), F.col("p_start"), F.col("p_end"))
    first = near.filter(fits).groupBy("child").agg(F.min(F.struct("ord", "parent")).alias("m")).select("child", F.col("m.parent").alias("parent"))
    return children.select("child").distinct().join(first, "child", "left")


def _held(cds: Column, exons: Column) -> Column:
    """Whether a chain of coding parts fits an exon chain: inside it, with the same introns between."""
    inner = F.filter(introns(exons), lambda i: (i["start"] > F.element_at(cds, 1)["start"]) & (i["end"] < F.element_at(cds, -1)["end"]))
    ends = F.exists(exons, lambda e: (e["start"] <= F.element_at(cds, 1)["start"]) & (e["end"] >= F.element_at(cds, 1)["end"])) & F.exists(
        exons, lambda e: (e["start"] <= F.element_at(cds, -1)["start"]) & (e["end"] >= F.element_at(cds, -1)["end"])
    )
    return ends & (inner == introns(cds))


def gene_segment_chains(chains: DataFrame, segments: DataFrame) -> DataFrame:
    """(gene, chain, ord, cds) and (gene, segment, exons), arrays in order: gene, chain, segment.

    Chains choose in their order: the segment that holds the chain, has the fewest bases beside it,
    then the least name, and is not taken; null where none is left. One gene's children are one group.
    """
    pairs = chains.join(segments, "gene").filter(_held(F.col("cds"), F.col("exons")))
    choice = F.struct((exons_len(F.col("exons")) - exons_len(F.col("cds"))).alias("spare"), F.col("segment").alias("segment"))
    options = pairs.groupBy("gene", "chain", "ord").agg(F.transform(F.array_sort(F.collect_list(choice)), lambda c: c["segment"]).alias("options"))
    per = options.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("ord", "chain", "options"))).alias("g"))
    none = F.transform(F.filter("g", lambda x: F.lit(False)), lambda x: F.struct(x["chain"].alias("chain"), F.element_at(x["options"], 1).alias("segment")))

    def step(done: Column, x: Column) -> Column:
        free = F.filter(x["options"], lambda o: ~F.exists(done, lambda d: d["segment"] == o))
        taken = F.concat(done, F.array(F.struct(x["chain"].alias("chain"), F.try_element_at(free, F.lit(1)).alias("segment"))))
        return F.when(F.size(free) > 0, taken).otherwise(done)

    got = per.select("gene", F.explode(F.aggregate("g", none, step)).alias("d")).select("gene", F.col("d.chain").alias("chain"), F.col("d.segment").alias("segment"))
    return chains.select("gene", "chain").join(got, ["gene", "chain"], "left")


def promoted(parts: DataFrame, parents: DataFrame) -> DataFrame:
    """(parent_id, contig, strand, start, end) whose parent no record defines -> id, contig, strand, start, end,
    exons: a transcript over the parts of each such parent on each contig and strand."""
    lost = parts.filter("parent_id is not null").join(parents.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_anti")
    spans = F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))))
    return lost.groupBy(F.col("parent_id").alias("id"), "contig", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"), spans.alias("exons"))


def joined_parts(parts: DataFrame) -> DataFrame:
    """(key, kind, start, end), kind exon or CDS -> key, kind, start, end: parts of a key as one where they overlap or
    touch, but of two CDS only where they touch. A union with a CDS is a CDS. A key's parts are one group."""
    row = F.struct("start", "end", "kind")
    kind = "array<struct<start:bigint,end:bigint,kind:string>>"

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        coding = (last["kind"] == "CDS") & (x["kind"] == "CDS")
        meets = F.when(coding, x["start"] == last["end"] + 1).otherwise(x["start"] <= last["end"] + 1)
        held = (x["start"] >= last["start"]) & (x["end"] <= last["end"])
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"),
            F.when((last["kind"] == "CDS") | (x["kind"] == "CDS"), "CDS").otherwise(last["kind"]).alias("kind"))
        return F.when(F.size(done) == 0, F.array(x)).when(held, done).when(meets,
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(x)))

    sound = parts.filter("start <= end").withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})
    per = sound.groupBy("key").agg(F.array_sort(F.collect_list(row)).alias("g"))
    return per.select("key", F.inline(F.aggregate(F.col("g").cast(kind), F.array().cast(kind), step))).select("key", "kind", "start", "end")
