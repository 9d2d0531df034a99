"""Transcripts as rows with a sorted array of exons: comparison, synthesis, features."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import exons_len, introns
from .intervals import BLOCK, clusters, overlap_join
from .stored import dealt, stored

EXONS = "array<struct<start:bigint,end:bigint>>"


def assemble(exons: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Exon rows to transcripts: start, end, exons in order; of ``keep`` columns the least value counts."""
    firsts = [F.min(c).alias(c) for c in keep]
    out = exons.groupBy(key).agg(*firsts, F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons"))
    return out.withColumns({"start": F.element_at("exons", 1)["start"], "end": F.element_at("exons", -1)["end"]})


def merge_close(exons: Column, gap: int = 4) -> Column:
    """Joins sorted exons with at most ``gap`` bases between them."""

    def step(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(F.size(done) == 0, F.array(x)).when(x["start"] - last["end"] - 1 <= gap, joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(exons, F.array().cast(EXONS), step)


def united(exons: DataFrame, key: str, keep: tuple[str, ...] = (), gap: int = 1) -> DataFrame:
    """As ``assemble``, exons at most ``gap`` apart (1: they may touch) being one: for keys whose exons are few. One
    aggregation brings them together; rows are sorted and joined in place."""
    # joined within the aggregation: no filter that is pushed down makes the exons again; dealt by key first, as few
    # rows of a key meet before a shuffle, and a partial aggregation of them sorts all rows once more
    whole = merge_close(F.sort_array(F.collect_list(F.struct("start", "end"))), gap - 1)
    x = exons.filter("start <= end")
    x = dealt(x, x, key).groupBy(key).agg(*(F.min(c).alias(c) for c in keep), whole.alias("exons"))
    return x.withColumns({"start": F.element_at("exons", 1)["start"], "end": F.element_at("exons", -1)["end"]})


def structure_match(a: Column, b: Column, single_share: float = 0.8, reach: int = 100) -> Column:
    """Same intron chain and ends within reach; single exons: overlap of the longer at least the share."""
    one = (F.size(a) == 1) & (F.size(b) == 1)
    x, y = F.element_at(a, 1), F.element_at(b, 1)
    both = F.greatest(F.lit(0), F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]) + 1)
    ends = (F.abs(x["start"] - y["start"]) <= reach) & (F.abs(F.element_at(a, -1)["end"] - F.element_at(b, -1)["end"]) <= reach)
    return F.when(one, both / F.greatest(exons_len(a), exons_len(b)) >= single_share).otherwise((F.size(a) == F.size(b)) & (introns(a) == introns(b)) & ends)


def nascents(tx: DataFrame) -> DataFrame:
    """For each intron of a transcript, a prefix in its own direction whose last exon runs through it."""
    n = F.size("exons")
    out = tx.filter(n > 1).select("*", F.explode(F.sequence(F.lit(1), n - 1)).alias("step"))
    at, exon = n - F.col("step") + 1, lambda k: F.element_at("exons", k)
    fore_end, back_start = exon(F.col("step") + 1)["start"] - 1, exon(at - 1)["end"] + 1
    fore = F.concat(F.slice("exons", 1, F.col("step") - 1), F.array(F.struct(exon(F.col("step"))["start"].alias("start"), fore_end.alias("end"))))
    back = F.concat(F.array(F.struct(back_start.alias("start"), exon(at)["end"].alias("end"))), F.slice("exons", at + 1, F.col("step") - 1))
    own = lambda reverse, forward: F.when(F.col("strand") == "-", reverse).otherwise(forward)
    return out.withColumns({"exons": own(back, fore), "start": own(back_start, exon(1)["start"]), "end": own(exon(-1)["end"], fore_end)})


def _matching(share: float, reach: int):
    """A test of a span (start, end, whether of a single exon) against those kept before, with which it is kept if it is
    like none. They lie in buckets by length and start, or by both ends, so that it is compared with those near it only."""
    base = max(1 / share, 1 + 1e-9)
    width = cache(lambda c: int((1 - share) * base ** (c + 3)) + 1)
    w, log = reach + 1, math.log(base)

    def new(kept: dict, s: int, e: int, one: bool) -> bool:
        if one:
            c = int(math.log(e - s + 1) / log)
            own = (c, s // width(c))
            near = [(d, s // width(d) + k) for d in range(c - 2, c + 3) for k in (-1, 0, 1)]
            alike = lambda u, v: (min(e, v) - max(s, u) + 1) / max(e - s + 1, v - u + 1) >= share
        else:
            own = (s // w, e // w)
            near = [(own[0] + i, own[1] + k) for i in (-1, 0, 1) for k in (-1, 0, 1)]
            alike = lambda u, v: abs(s - u) <= reach and abs(e - v) <= reach
        for key in near:
            if key in kept and any(alike(u, v) for u, v in kept[key]):
                return False
        kept.setdefault(own, []).append((s, e))
        return True

    return new


def _fresh(rows) -> np.ndarray:
    """Of sorted rows in Arrow, which begin a group (contig, cluster_, chain_)."""
    import pyarrow.compute as pc

    plain = lambda x: x.combine_chunks() if hasattr(x, "combine_chunks") else x
    chain = plain(rows["chain_"])
    n = pc.list_value_length(chain).to_numpy(zero_copy_only=False)
    flat = chain.flatten()
    out = np.ones(len(n), bool)
    out[1:] = n[1:] != n[:-1]
    row = np.repeat(np.arange(len(n)), n)
    back = np.arange(len(row)) - n[row]  # the same intron of the row ahead, where that has as many
    for c in ("start", "end"):
        x = pc.fill_null(pc.struct_field(flat, c), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        out[row[x != x[back]]] = True
    for c in ("contig", "cluster_"):
        x = plain(rows[c])
        out[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
    return out


def distinct_nascents(tx: DataFrame, *order: str, share: float = 0.99, reach: int = 70) -> DataFrame:
    """Nascents without those that match the structure of one kept before, on either strand.

    ``order`` ranks the transcripts; nascents of one follow by step. What can match has the same
    introns, or lies in the same cluster of single exons: the rows of such a group pass one task in order, which
    holds those kept of it alone, in time linear in them. Rows without a contig, and those of
    overlapping exons whose span would be empty, are left out.
    """
    import pyarrow as pa

    whole = tx.filter("contig is not null").withColumn("chain_", introns(F.col("exons")))
    step, size = F.col("step"), F.size("chain_")
    own = F.slice("chain_", F.when(F.col("strand") == "-", size + 2 - step).otherwise(1), step - 1)  # a nascent has introns of its transcript
    rows = stored(nascents(whole).withColumn("chain_", own).filter("start <= end"), "nascents")
    single = clusters(rows.filter(size == 0), 0, name="cluster_", block=BLOCK)
    both = single.unionByName(rows.filter(size > 0).withColumn("cluster_", F.lit(-1).cast("long")))
    same = ["contig", "cluster_", "chain_"]
    lined = dealt(both.withColumn("h_", F.xxhash64(*same)), rows, "h_").sortWithinPartitions("h_", *same, *order, "step").drop("h_")
    out = [c for c in rows.columns if c != "chain_"]

    def keep(batches):
        new, kept, last = _matching(share, reach), {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ahead = [] if last is None else [last]
            fresh = _fresh(pa.Table.from_batches([*ahead, batch]).select(same))[len(ahead) :]
            last = batch.slice(batch.num_rows - 1)
            at = np.flatnonzero(~(fresh & np.append(fresh[1:], False)))  # but rows that are a group alone
            of = lambda c: batch.column(c).to_numpy(zero_copy_only=False)[at].tolist()  # noqa: B023, E731
            good = np.ones(batch.num_rows, bool)
            for i, first, s, e, cluster in zip(at.tolist(), fresh[at].tolist(), of("start"), of("end"), of("cluster_"), strict=True):
                kept = {} if first else kept
                good[i] = new(kept, s, e, cluster >= 0)
            yield batch.filter(pa.array(good)).select(out)

    return lined.mapInArrow(keep, rows.select(*out).schema)


def cds_phases(exons: DataFrame, key: str) -> DataFrame:
    """Exon rows with the phase of each: what the bases before it in reading direction leave over."""
    order = Window.partitionBy(key).orderBy(F.when(F.col("strand") == "-", -F.col("end")).otherwise(F.col("start")), "start", "end")
    before = F.coalesce(F.sum(F.col("end") - F.col("start") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return exons.withColumn("phase", ((3 - before % 3) % 3).cast("int"))


def features(exons: DataFrame, key: str) -> DataFrame:
    """Distinct (contig, start, end, strand) with the sorted owners and gap-free ids in sort order.

    Ids come from ranks within a block of a contig on top of the blocks before it: the one window over
    everything sees one row a block.
    """
    at = ["contig", "block_"]
    cells = exons.groupBy("contig", "start", "end", "strand").agg(F.array_sort(F.collect_set(key)).alias("owners")).withColumn("block_", F.floor(F.col("start") / BLOCK))
    counts = cells.groupBy(*at).agg(F.count("*").alias("n_"))
    base = counts.select(*at, F.coalesce(F.sum("n_").over(Window.orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base_"))
    rank = F.row_number().over(Window.partitionBy(*at).orderBy("start", "end", "strand"))
    return cells.join(base, at).select((F.col("base_") + rank).alias("id"), "contig", "start", "end", "strand", "owners")


def expressed(tx: DataFrame, gene: str, cov: str, share: float = 0.01, least: float = 1.0) -> DataFrame:
    """Transcripts with at least ``least`` coverage and a share of their gene's best."""
    top = F.max(cov).over(Window.partitionBy(gene))
    return tx.withColumn("top_", top).filter((F.col(cov) >= least) & (F.col(cov) >= share * F.col("top_"))).drop("top_")


def merge_by_chain(tx: DataFrame, key: str) -> DataFrame:
    """Transcripts of several exons with one intron chain become one with the widest ends: contig,
    strand, chain, start, end, n, first_<key>."""
    x = tx.select(key, "contig", "strand", "start", F.array_max(F.transform("exons",
        lambda e: e["end"])).alias("end"), introns(F.col("exons")).alias("chain")).filter("size(chain) > 0")
    return x.groupBy("contig", "strand", "chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.min(key).alias(f"first_{key}"))


def passing(tx: DataFrame, length: int = 50, cov: float = 0.0, fpkm: float = 1.0, tpm: float = 1.0) -> DataFrame:
    """Transcripts (exons, cov, fpkm, tpm) of at least a length and least values; a missing value, null or
    negative, passes its test."""
    enough = lambda c, least: F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) >= least)
    return tx.filter((exons_len(F.col("exons")) >= length) & enough("cov", cov) & enough("fpkm", fpkm) & enough("tpm", tpm))


def merge_isoforms(tx: DataFrame, key: str, label: str = "MSTRG", gap: int = 250) -> DataFrame:
    """Transcripts of several inputs as one set: gene_id, transcript_id, contig, strand, exons, n, first_<key>.

    Those with one intron chain become one with the widest ends. Single exons become one where they
    overlap, unless an exon of a kept chain on their strand holds them whole. Transcripts of a strand that lie at
    most ``gap`` apart are one gene. Genes are numbered by contig, strand and place, transcripts in a gene by
    their place; single exons on no strand are left out beside stranded ones that hold them.
    """
    tx = stored(tx.select(key, "contig", "strand", "start", "exons"), "merging")
    chains = merge_by_chain(tx, key).withColumnRenamed(f"first_{key}", "first_")
    inner_starts, inner_ends = F.transform("chain", lambda i: i["end"] + 1), F.transform("chain", lambda i: i["start"] - 1)
    exons = F.zip_with(F.concat(F.array("start"), inner_starts), F.concat(inner_ends, F.array("end")), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    many = stored(chains.select("contig", "strand", "start", "end", exons.alias("exons"), "n", "first_"), "chains")
    single = tx.filter(F.size("exons") == 1).select("contig", "strand", "start", F.element_at("exons", 1)["end"].alias("end"), F.col(key).alias("first_"))
    united = clusters(single, 0, ("contig", "strand"), "cluster_", BLOCK).groupBy("contig", "strand", "cluster_").agg(F.min("start").alias("start"),
        F.max("end").alias("end"), F.count("*").alias("n"), F.min("first_").alias("first_"))
    held = overlap_join(united.select("contig", "strand", "start", "end"), many.select("contig", "strand",
        F.explode("exons").alias("e")).select("contig", "strand", "e.start", "e.end"))
    held = held.filter("(a_strand = b_strand or a_strand = '.') and a_start >= b_start and a_end <= b_end").select(F.col("a_contig").alias("contig"),
        F.col("a_strand").alias("strand"), F.col("a_start").alias("start"), F.col("a_end").alias("end")).distinct()
    alone = united.join(held, ["contig", "strand", "start", "end"], "left_anti").select("contig", "strand", "start", "end",
        F.array(F.struct("start", "end")).alias("exons"), "n", "first_")
    rows = clusters(many.unionByName(alone), gap, ("contig", "strand"), "locus_", BLOCK)
    rows = stored(rows, "isoforms")
    at = ["contig", "strand", "locus_"]
    genes = rows.groupBy(*at).agg(F.lit(1).alias("one_"))
    sizes = genes.groupBy("contig", "strand").agg(F.count("*").alias("n_"))  # one row for each contig and strand
    base = sizes.select("contig", "strand",
        F.coalesce(F.sum("n_").over(Window.orderBy("contig", "strand").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base_"))
    rank = F.row_number().over(Window.partitionBy(*at).orderBy("start", "end", "exons"))
    gene = F.concat(F.lit(f"{label}."), (F.col("base_") + F.col("locus_")).cast("string"))
    out = rows.withColumn("rank_", rank).join(base, ["contig", "strand"]).withColumn("gene_id", gene)
    return out.select("gene_id", F.concat_ws(".", "gene_id",
        F.col("rank_").cast("string")).alias("transcript_id"), "contig", "strand", "exons", "n", F.col("first_").alias(f"first_{key}"))
