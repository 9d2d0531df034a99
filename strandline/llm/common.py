"""Helpers shared by the training-data operators.

All operators take and return DataFrames. Python runs only through ``arrow_map``:
Arrow batches cut into pieces of bounded bytes, so that a worker's memory does not
follow the length of a partition or of a batch.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE_BYTES, BATCH_ROWS = 1 << 20, 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Only a local session, as in tests, gets a temporary folder where it is unset: on a cluster
    executors could not read each other's files there, so that is an error.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="strandline-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  (at exit the session may be gone; a folder left over does no harm)
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and outlives executors.

    The folder goes when ``discard`` is called, at the latest when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    atexit.register(_delete, spark, path)
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what ``materialize`` wrote; nothing that is still to be computed may read it."""
    for df in frames:
        _delete(df.sparkSession, df._written)


def pieces(batch: pa.RecordBatch, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``most`` bytes; a longer row is a piece of its own."""
    n = batch.num_rows
    if n == 0:
        return
    rows = np.zeros(n, np.int64)
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
            width = np.int32 if pa.types.is_string(col.type) else np.int64
            off = np.frombuffer(col.buffers()[1], width)[col.offset : col.offset + n + 1]
            rows += np.diff(off)
    group = (np.cumsum(rows) - rows) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``make`` is called once a task; what it returns maps each piece to output rows.

    Lowers spark.sql.execution.arrow.maxRecordsPerBatch of the session to ``BATCH_ROWS`` where it is higher:
    Spark reads that setting only when the result is computed, so it can't be set back here.
    A column ``row`` of df (see ``judged``) goes through unchanged; the work must then return a row for each row.
    """
    conf = df.sparkSession.conf  # texts are long: batches of many rows would fill a worker's memory
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    whole = "row" in df.columns
    if whole:
        schema = f"{schema}, row {df.schema['row'].dataType.simpleString()}"

    def run(batches):
        work = make()
        for batch in batches:
            for piece in pieces(batch):
                out = work(piece)
                yield pa.RecordBatch.from_arrays([*out.columns, piece["row"]], [*out.schema.names, "row"]) if whole else out

    return df.mapInArrow(run, schema)


def judged(docs: DataFrame, rows: bool) -> DataFrame:
    """doc_id and text, and with ``rows`` the whole row as a struct, whatever its columns are called."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.struct(*(docs[c] for c in docs.columns)).alias("row")] if rows else []))


def byte_texts(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; null is empty."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


_WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of Unicode category L; signs such as ² and ½ are none."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text or ""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that small integers become well-spread hashes."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
