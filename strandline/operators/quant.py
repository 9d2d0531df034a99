"""Counting, coverage and normalisation of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exon_counts(pairs: DataFrame, key: str = "b_id", nh: str = "a_nh") -> DataFrame:
    """Reads, unique reads and multi-map weighted reads and bases of each feature."""
    size = F.least("a_end", "b_end") - F.greatest("a_start", "b_start") + 1
    return pairs.groupBy(F.col(key).alias("id")).agg(
        F.count("*").alias("rcount"), F.count_if(F.col(nh) <= 1).alias("ucount"), F.sum(1 / F.col(nh)).alias("mrcount"),
            F.sum(size / F.col(nh)).alias("movlcount"), F.sum(size).alias("bases")
    )


def fpkm(cov: Column, frag_len: Column) -> Column:
    return F.when(frag_len > 0.001, F.greatest(cov, F.lit(0.0)) * 1e9 / frag_len).otherwise(0.0)


def tpm(cov: Column, cov_sum: Column) -> Column:
    return F.when(cov_sum > 1e-5, F.greatest(cov, F.lit(0.0)) * 1e6 / cov_sum).otherwise(0.0)


def normalise(features: DataFrame, cov: str = "cov", bases: str = "bases") -> DataFrame:
    """FPKM and TPM against totals; the totals are one row, so broadcasting them is safe."""
    totals = features.agg(F.sum(bases).cast("double").alias("frag_len"), F.sum(F.greatest(F.col(cov), F.lit(0.0))).alias("cov_sum"))
    out = features.crossJoin(F.broadcast(totals))
    return out.withColumns({"fpkm": fpkm(F.col(cov), F.col("frag_len")), "tpm": tpm(F.col(cov), F.col("cov_sum"))}).drop("frag_len", "cov_sum")


def reads_of(cov: Column, length: Column, read_len: int = 75) -> Column:
    """Reads behind a coverage."""
    return F.ceil(cov * length / read_len)


def matrix(counts: DataFrame, row: str, sample: str, value: str, samples: list[str]) -> DataFrame:
    """A column for each sample; absent is 0. Naming the samples saves a pass over the data."""
    return counts.groupBy(row).pivot(sample, samples).agg(F.sum(value)).na.fill(0)
