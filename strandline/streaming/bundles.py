"""Streams: gap-separated bundles as session windows, and k-mer lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import canonical, kmers


def stream_bundles(points: DataFrame, gap: int, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """(contig, time): sessions separated by more than gap seconds; state goes once the watermark is past."""
    window = F.session_window(time, f"{gap} seconds")
    return points.withWatermark(time, delay).groupBy("contig", window).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))


def stream_lookup(reads: DataFrame, counts: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Counts of a stream's k-mers from a static table; absent is 0."""
    mers = reads.select("*", F.explode(kmers(F.col(seq), k)).alias("mer")).withColumn("mer", canonical(F.col("mer")))
    return mers.join(counts, "mer", "left").withColumn("count", F.coalesce("count", F.lit(0)))
