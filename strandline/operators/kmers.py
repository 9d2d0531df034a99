"""k-mer tables: (mer, count) and what is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import canonical, kmers

SHORT = 12


def count_kmers(reads: DataFrame, k: int, both_strands: bool = True, seq: str = "seq", least: int = 1) -> DataFrame:
    """Counts of k-mers, one count for both strands where canonical.

    Short k-mers are few: they are counted as they stand, so that strands are compared once for each
    distinct one. Long k-mers are mostly distinct: those are made canonical first, for one shuffle.
    """
    mers = reads.select(F.explode(kmers(F.col(seq), k)).alias("mer"))
    sound = F.col("mer").rlike("^[ACGTacgt]+$")
    if both_strands and k > SHORT:
        mers = mers.select(canonical(F.col("mer")).alias("mer"))
    out = mers.groupBy("mer").agg(F.count("*").alias("count")).filter(sound)
    if both_strands and k <= SHORT:
        out = out.groupBy(canonical(F.col("mer")).alias("mer")).agg(F.sum("count").alias("count"))
    return out.filter(F.col("count") >= least) if least > 1 else out


def histogram(counts: DataFrame, base: int = 1, ceil: int = 10000, increment: int = 1) -> DataFrame:
    """k-mers by count; what is under base or over ceil goes to a bucket beyond that end."""
    low = base - increment if base > 1 else base
    bucket = F.when(F.col("count") < base, low).when(F.col("count") > ceil, ceil + increment).otherwise(F.floor((F.col("count") - base) / increment) * increment + base)
    return counts.groupBy(bucket.cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def stats(counts: DataFrame, lower: int | None = None, upper: int | None = None) -> DataFrame:
    """Unique, distinct and total k-mers and the greatest count, of counts within the bounds."""
    if lower is not None:
        counts = counts.filter(F.col("count") >= lower)
    if upper is not None:
        counts = counts.filter(F.col("count") <= upper)
    return counts.agg(F.count_if(F.col("count") == 1).alias("uniq"), F.count("*").alias("distinct_mers"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.coalesce(F.max("count"), F.lit(0)).alias("max_count"))


def merge_counts(*tables: DataFrame, least: int = 1) -> DataFrame:
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)
    return both.groupBy("mer").agg(F.sum("count").alias("count")).filter(F.col("count") >= least)


def query(counts: DataFrame, mers: DataFrame) -> DataFrame:
    return mers.join(counts, "mer", "left").select(*mers.columns, F.coalesce("count", F.lit(0)).alias("count"))


def quality_counts(occurrences: DataFrame, most: int) -> DataFrame:
    """(mer, high 0/1) -> count and quality: high occurrences alone count where there is one."""
    out = occurrences.groupBy("mer").agg(F.max("high").alias("hq"), F.sum("high").alias("s"), F.count("*").alias("n"))
    return out.select("mer", F.least(F.lit(most), F.when(F.col("hq") == 1, F.col("s")).otherwise(F.col("n"))).alias("count"), "hq")


def quality_totals(counted: DataFrame, most: int) -> DataFrame:
    """As ``quality_counts``, from (mer, high, n) that is counted already."""
    out = counted.groupBy("mer").agg(F.max("high").alias("hq"), F.sum(F.col("high") * F.col("n")).alias("s"), F.sum("n").alias("n"))
    return out.select("mer", F.least(F.lit(most), F.when(F.col("hq") == 1, F.col("s")).otherwise(F.col("n"))).alias("count"), "hq")


def nx(sizes: DataFrame, shares: tuple[int, ...] = (10, 25, 50, 90), size: str = "size", genome: int | None = None, block: int = 1 << 12) -> DataFrame:
    """Nx for each share, of all sizes or a genome's (null where unreachable), total, records, average and
    E-size (the mean size of the record that a base lies in).

    Sizes are counted before they are ordered, and ranked within blocks of sizes on top of what longer
    blocks hold: the one window over everything sees one row a block.
    """
    counts = sizes.filter(F.col(size).isNotNull()).groupBy(F.col(size).cast("long").alias("size")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("block_", F.floor(F.col("size") / block))
    held = F.col("n") * F.col("size")
    blocks = counts.groupBy("block_").agg(F.sum(held).alias("held_"))
    above = Window.orderBy(F.desc("block_")).rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("block_", F.coalesce(F.sum("held_").over(above), F.lit(0)).alias("base_"))
    run = counts.join(base, "block_").withColumn("run", F.col("base_") + F.sum(held).over(Window.partitionBy("block_").orderBy(F.desc("size"))))
    goal = F.lit(genome) if genome else F.col("total_")
    total = counts.agg(F.sum(held).alias("total_"))  # one row
    out = run.crossJoin(F.broadcast(total)).agg(
        *(F.max(F.when(F.col("run") * 100 >= goal * s, F.col("size"))).alias(f"n{s}") for s in shares),
            F.coalesce(F.sum(held), F.lit(0)).alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        (F.sum(held) / F.sum("n")).alias("average"), (F.sum((held * F.col("size")).cast("double")) / F.sum(held)).alias("e_size"),
    )
    return out


def length_stats(sizes: DataFrame, size: str = "size") -> DataFrame:
    """Number, greatest and sum of lengths; zeros for none."""
    c = F.col(size).cast("long")
    return sizes.agg(F.count(c).alias("records"), F.coalesce(F.max(c), F.lit(0)).alias("longest"), F.coalesce(F.sum(c), F.lit(0)).alias("bases"))


def quality_histogram(counts: DataFrame, most: int = 1000) -> DataFrame:
    """(mer, count, hq) -> count (what is over ``most`` counts there), low and high: k-mers of either quality."""
    at = F.least(F.col("count"), F.lit(most)).cast("long").alias("count")
    return counts.groupBy(at).agg(F.count_if(F.col("hq") == 0).alias("low"), F.count_if(F.col("hq") == 1).alias("high"))


def count_seeded(reads: DataFrame, seeds: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Counts of the k-mers that ``seeds`` (mer) names, 0 for those not seen; others are passed by. Reads
    are counted first, so each distinct k-mer meets the seeds once."""
    wanted = seeds.select(canonical(F.col("mer")).alias("mer")).distinct()
    return query(count_kmers(reads, k, seq=seq).join(wanted, "mer", "left_semi"), wanted)


def updated(counts: DataFrame, reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """A table with the reads' k-mers added to those that it holds; no new k-mers come in."""
    more = count_kmers(reads, k, seq=seq).select("mer", F.col("count").alias("more_"))
    return counts.join(more, "mer", "left").select("mer", (F.col("count") + F.coalesce("more_", F.lit(0))).alias("count"))


def table_entries(genome: int, k: int, reads: int, full: float = 0.8) -> int:
    """Entries to reserve for a k-mer table: a genome's, and k for each read (of an error in it), at a load."""
    return -(-int((genome + k * reads) * 1000) // int(full * 1000))
