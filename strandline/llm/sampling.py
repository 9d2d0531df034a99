"""Bounded samples of labelled rows for fitting; nothing else may look at a part of the rows.

Which rows are taken depends on hashes of ids and texts alone, so a sample is the same at every number
of partitions. Rows are capped in the cluster, before the driver collects them: at most ``2 * most``
of a label, ``MOST_BYTES`` of text in all, and the ``MOST_LABELS`` labels with the most rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_LABELS, MOST_BYTES = 500, 64 << 20
_DRAWS = 1 << 40


def _share(labels: DataFrame, most: int) -> DataFrame:
    """label_, limit_: what an id's draw must be under for about ``most`` ids (a fifth more) of each label."""
    counts = labels.groupBy("label_").agg(F.approx_count_distinct("id_", 0.02).alias("n")).orderBy(F.desc("n"), "label_").limit(MOST_LABELS).collect()
    rows = [(r["label_"], int(min(1.0, 1.2 * most / max(r["n"], 1)) * _DRAWS)) for r in counts]
    return labels.sparkSession.createDataFrame(rows, f"label_ {labels.schema['label_'].dataType.simpleString()}, limit_ long")


def _draw(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(_DRAWS))


def _capped(rows: DataFrame, most: int, labels: int) -> list[tuple[bytes, object]]:
    """(text, label) of text_, label_, in a stable order and within the bounds."""
    order = Window.partitionBy("label_").orderBy(_draw("text_"), "text_")
    few = rows.withColumn("k_", F.row_number().over(order)).filter(F.col("k_") <= 2 * most)  # cut in each task before the shuffle
    size = F.sum(F.octet_length("text_")).over(Window.partitionBy("label_").orderBy("k_").rowsBetween(Window.unboundedPreceding, 0))
    got = few.withColumn("bytes_", size).filter(F.col("bytes_") <= MOST_BYTES // max(labels, 1)).select("label_", "text_", "k_").collect()
    return [(r["text_"].encode(), r["label_"]) for r in sorted(got, key=lambda r: (str(r["label_"]), r["k_"]))]


def own_sample(rows: DataFrame, label: str, most: int) -> list[tuple[bytes, object]]:
    """(text, label) of about ``most`` ids of each label, from rows that carry their own label.

    Rows with a null text or label are left out; an id may stand on several rows, each with its label.
    """
    labelled = rows.select(F.col("doc_id").alias("id_"), F.col("text").alias("text_"), F.col(label).alias("label_")).filter("label_ is not null")
    share = _share(labelled.select("id_", "label_"), most)
    # Broadcast: a row for each of at most MOST_LABELS labels.
    taken = labelled.filter("text_ is not null").join(F.broadcast(share), "label_").filter(_draw("id_") < F.col("limit_"))
    return _capped(taken.select("text_", "label_"), most, share.count())


def joined_sample(docs: DataFrame, labelled: DataFrame, label: str, most: int) -> list[tuple[bytes, object]]:
    """(text, label) of about ``most`` ids of each label; ``labelled`` (doc_id, label) has an id once.

    Each row of ``docs`` with such an id is a candidate; rows with a null are left out.
    """
    ids = labelled.select(F.col("doc_id").alias("id_"), F.col(label).alias("label_")).filter("id_ is not null and label_ is not null")
    share = _share(ids, most)
    chosen = ids.join(F.broadcast(share), "label_").filter(_draw("id_") < F.col("limit_")).select("id_", "label_")
    # Broadcast: the draw bounds the ids by ``most`` and the number of labels.
    rows = docs.select("doc_id", F.col("text").alias("text_")).filter("text_ is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("id_"))
    return _capped(rows.select("text_", "label_"), most, share.count())
