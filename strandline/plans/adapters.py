"""The driver's tables seen as intervals, transcripts and sequences, in Spark and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def iv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as alignments: id, contig, start, end, strand, nh, gene, flag."""
    e = table(spark, sf_dir, "events")
    start = seconds(F.col("ts"))
    strand = F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(".")), (F.length("event_type") % 3 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("contig"), start.alias("start"), (start + F.floor(F.col("value") * 100)).alias("end"),
        strand.alias("strand"), (1 + F.col("event_id") % 4).alias("nh"), F.col("event_type").alias("gene"), (F.col("event_id") * 37 % 4096).cast("int").alias("flag"),
    )


IV = """iv AS (SELECT event_id AS id, user_id % 20 AS contig, floor(epoch(ts))::BIGINT AS "start", floor(epoch(ts))::BIGINT + floor(value * 100)::BIGINT AS "end",
  ['+', '-', '.'][length(event_type) % 3 + 1] AS strand, 1 + event_id % 4 AS nh, event_type AS gene, (event_id * 37 % 4096)::INT AS flag FROM events)"""


def guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv(spark, sf_dir).filter("id % 2 = 1")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv(spark, sf_dir).filter("id % 2 = 0")


PAIRS = IV + """, g AS (SELECT * FROM iv WHERE id % 2 = 1), r AS (SELECT * FROM iv WHERE id % 2 = 0),
pairs AS (SELECT r.id AS a_id, r.contig, r."start" AS a_start, r."end" AS a_end, r.strand AS a_strand, r.nh AS a_nh, g.id AS b_id, g."start" AS b_start, g."end" AS b_end, g.strand AS b_strand, g.gene AS b_gene,
  least(r."end", g."end") - greatest(r."start", g."start") + 1 AS ovlen FROM r JOIN g ON r.contig = g.contig AND r."start" <= g."end" AND g."start" <= r."end")"""


def exon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as exon rows, repeats included: tx, contig, strand, start, end; contig and strand follow the transcript."""
    x = table(spark, sf_dir, "lineitem")
    start = F.col("l_partkey") * 100
    return x.select(F.col("l_orderkey").alias("tx"), (F.col("l_orderkey") % 10).alias("contig"),
        F.when(F.col("l_orderkey") % 3 == 0, "-").otherwise("+").alias("strand"), start.alias("start"),
        (start + F.col("l_quantity").cast("long")).alias("end"))


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct exon rows."""
    return exon_rows(spark, sf_dir).distinct()


EX = """ex AS (SELECT DISTINCT l_orderkey AS tx, l_orderkey % 10 AS contig, CASE WHEN l_orderkey % 3 = 0 THEN '-' ELSE '+' END AS strand,
  l_partkey * 100 AS "start", l_partkey * 100 + l_quantity::BIGINT AS "end" FROM lineitem)"""
#: Exons of one transcript that start together are one; then starts tell exons apart.
TX = EX + """, mx AS (SELECT tx, any_value(contig) AS contig, any_value(strand) AS strand, "start", max("end") AS "end" FROM ex GROUP BY tx, "start")"""


def merged_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exons(spark, sf_dir).groupBy("tx", "start").agg(F.first("contig").alias("contig"), F.first("strand").alias("strand"), F.max("end").alias("end"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as DNA: id, seq."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


SEQ = "seqs AS (SELECT doc_id AS id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"
MERS = SEQ + """, mers AS (SELECT substr(seq, i, {k}) AS m FROM seqs, unnest(range(1, length(seq) - {k} + 2)) AS u(i)),
canon AS (SELECT least(m, reverse(translate(m, 'ACGT', 'TGCA'))) AS mer FROM mers), kc AS (SELECT mer, count(*) AS "count" FROM canon GROUP BY mer)"""
