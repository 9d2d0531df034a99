"""Places in files: rows kept by contig and place, sequences kept in chunks, and what a file is by its first bytes."""

from __future__ import annotations

import bz2
import gzip
import lzma
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 16
#: First bytes of packed files, and of formats when unpacked.
_PACKED = ((b"\x1f\x8b", "gzip"), (b"BZh", "bzip2"), (b"\xfd7zXZ\0", "xz"))
_KINDS = ((b"BAM\1", "bam"), (b"CRAM", "cram"), (b"BCF\2", "bcf"), (b"BAI\1", "bai"), (b"TBI\1", "tbi"), (b"CSI\1", "csi"),
    (b"##fileformat=VCF", "vcf"), (b"##gff-version", "gff3"))
_HEADS = (b"@HD\t", b"@SQ\t", b"@RG\t", b"@PG\t", b"@CO\t")


def write_indexed(df: DataFrame, path: str) -> None:
    """Rows (contig, start, end, ..) in folders by contig, each file a run of starts in order: a reader of a
    region opens the contig's folder and, by the least and greatest values kept in files, the parts that matter. Rows are
    dealt by ranges of (contig, start), so a hot contig is many files."""
    df.repartitionByRange("contig", "start").sortWithinPartitions("contig", "start").write.partitionBy("contig").parquet(path)


def read_regions(spark: SparkSession, path: str, *regions: tuple[str, int, int]) -> DataFrame:
    """Rows that overlap any of the regions (contig, first, last), each row once; filters reach the scan."""
    hit = F.lit(False)
    for contig, first, last in regions:
        hit = hit | ((F.col("contig") == contig) & (F.col("start") <= last) & (F.col("end") >= first))
    return spark.read.parquet(path).filter(hit)


def chunked(seqs: DataFrame, size: int = CHUNK) -> DataFrame:
    """(name, seq) -> name, chunk, seq: sequences in pieces, so that a long one is many rows."""
    n = F.ceil(F.length("seq") / size).cast("int")
    at = F.explode(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: k < n)).alias("chunk")
    return seqs.select("name", at, "seq").select("name", "chunk", F.substring("seq", F.col("chunk") * size + 1, F.lit(size)).alias("seq"))


def fetch(chunks: DataFrame, regions: DataFrame, size: int = CHUNK) -> DataFrame:
    """(id, name, start, end), from 1 -> id, seq: what a sequence has there; only its chunks in reach are read.
    Nothing beyond its end; no row for an unknown name or a region that begins past the end."""
    first, last = F.greatest("start", F.lit(1)), F.col("end")
    span = F.transform(F.sequence(F.floor((first - 1) / size), F.floor((last - 1) / size)), lambda k: k.cast("int"))
    want = regions.filter((F.col("end") >= 1) & (first <= last)).select("id", "name", first.alias("from_"), last.alias("to_"), F.explode(span).alias("chunk"))
    base = F.col("chunk").cast("long") * size
    a, b = F.greatest(F.col("from_") - base, F.lit(1)), F.least(F.col("to_") - base, F.lit(size))
    parts = want.join(chunks, ["name", "chunk"]).select("id", "chunk", F.substring("seq", a.cast("int"), (b - a + 1).cast("int")).alias("part")).filter("part <> ''")
    return parts.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda p: p["part"]), "").alias("seq"))


def identify(head: bytes) -> tuple[str, str | None]:
    """(format, packing) by the first bytes of a file; ``text`` or ``data`` where they tell no more."""
    packing = next((name for magic, name in _PACKED if head.startswith(magic)), None)
    if packing == "gzip" and head[3:4] == b"\x04" and head[12:14] == b"BC":
        packing = "bgzf"
    data = head
    if packing:
        unpack = {"bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}.get(packing, lambda: zlib.decompressobj(16 + zlib.MAX_WBITS))()
        try:
            data = unpack.decompress(head)
        except (OSError, EOFError, zlib.error, lzma.LZMAError, gzip.BadGzipFile):
            return "data", packing
    known = next((name for magic, name in _KINDS if data.startswith(magic)), None)
    if known is None and data.startswith(_HEADS):
        known = "sam"
    if known is None and data[:1] in (b">", b"@"):
        known = "fasta" if data[:1] == b">" else "fastq"
    if known is None:
        line = data.split(b"\n", 1)[0].split(b"\t")
        number = lambda k: k < len(line) and line[k].isdigit()
        known = "sam" if len(line) >= 11 and number(1) and number(3) else "gtf" if len(line) == 9 and number(3) and number(4) else "bed" if len(line) >= 3 and number(1) and number(2) else None
    return known or ("text" if data and not set(data) & set(range(9)) else "data"), packing


def identified(spark: SparkSession, paths: str | list[str], look: int = 4096) -> DataFrame:
    """path, format, packing of files, by their first bytes; only those are read."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            found = []
            for path in batch["path"].to_pylist():
                system, name = fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))
                with system.open_input_stream(name, compression=None) as raw:
                    found.append((path, *identify(raw.read(look))))
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["path", "format", "packing"])

    return spark.read.format("binaryFile").load(paths).select("path").mapInArrow(run, "path string, format string, packing string")
