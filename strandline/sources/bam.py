"""Binary alignments as DataFrames and back: the columns of the text reader, and all tags as a map.

A file is inflated as a stream, record after record, so a worker holds one batch of rows whatever the
file's size. Files are read side by side, one task a file: their records do not begin at block
boundaries, so a range of a file can't be told apart from the middle of a record with certainty.
"""

from __future__ import annotations

import gzip
import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import with_blocks

ROWS = 2048
#: Letters of base codes and CIGAR operations, and the struct codes of number tags.
_BASES, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_TWO = [a + b for a in _BASES for b in _BASES]
_HEAD = struct.Struct("<iiBBHHHiiii")
_KIND = pa.schema(
    [("qname", pa.string()), ("flag", pa.int32()), ("contig", pa.string()), ("start", pa.int64()), ("mapq", pa.int32()), ("cigar",
        pa.string()), ("rnext", pa.string()), ("pnext", pa.int64()), ("tlen", pa.int64())]
    + [("seq", pa.string()), ("qual", pa.string()), ("tags", pa.map_(pa.string(), pa.string()))]
)
_OUT = "qname string, flag int, contig string, start long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags map<string,string>"


def _number(v: float) -> str:
    return f"{v:g}" if isinstance(v, float) else str(v)


def _tags(b: bytes, at: int) -> dict[str, str]:
    out: dict[str, str] = {}
    while at < len(b):
        name, kind, at = b[at : at + 2].decode(), chr(b[at + 2]), at + 3
        if kind == "A":
            value, at = chr(b[at]), at + 1
        elif kind in "ZH":
            end = b.index(0, at)
            value, at = b[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(b[at]), struct.unpack_from("<I", b, at + 1)[0]
            code = struct.Struct(f"<{n}{_NUMBERS[sub]}")
            value, at = ",".join([sub, *map(_number, code.unpack_from(b, at + 5))]), at + 5 + code.size
        else:
            code = struct.Struct("<" + _NUMBERS[kind])
            value, at = _number(code.unpack_from(b, at)[0]), at + code.size
        out.setdefault(name, value)
    return out


def _cigar(ops) -> str:
    return "".join(f"{x >> 4}{_OPS[x & 15]}" for x in ops) or "*"


def _row(b: bytes, names: list[str]) -> tuple:
    ref, pos, l_name, mapq, _, n_ops, flag, n_bases, mate_ref, mate_pos, tlen = _HEAD.unpack_from(b)
    at = _HEAD.size
    name, at = b[at : at + l_name - 1].decode(), at + l_name
    ops, at = struct.unpack_from(f"<{n_ops}I", b, at), at + 4 * n_ops
    packed = b[at : at + (n_bases + 1) // 2]
    at += len(packed)
    seq, qual = "".join(map(_TWO.__getitem__, packed))[:n_bases], b[at : at + n_bases]
    tags = _tags(b, at + n_bases)
    cigar = _cigar(ops)
    if "CG" in tags and cigar.startswith(f"{n_bases}S") and n_ops == 2:  # too many operations for the record's own field
        cigar = _cigar(map(int, tags.pop("CG").split(",")[1:]))
    contig = names[ref] if ref >= 0 else "*"
    mate = "*" if mate_ref < 0 else "=" if mate_ref == ref else names[mate_ref]
    scores = "*" if not qual or qual[0] == 255 else bytes(q + 33 for q in qual).decode("latin-1")
    return name, flag, contig, pos + 1, mapq, cigar, mate, mate_pos + 1, tlen, seq or "*", scores, list(tags.items())


def _records(source):
    """Rows of one file, given as a readable stream of packed bytes."""
    with gzip.GzipFile(fileobj=source) as f:

        def take(n: int) -> bytes:
            got = f.read(n)
            if len(got) != n:
                raise ValueError("an alignment file ends within a record")
            return got

        number = lambda: struct.unpack("<i", take(4))[0]
        if take(4) != b"BAM\1":
            raise ValueError("not a binary alignment file")
        take(number())
        names = []
        for _ in range(number()):
            names.append(take(number())[:-1].decode())
            number()
        while size := f.read(4):
            if len(size) != 4:
                raise ValueError("an alignment file ends within a record")
            yield _row(take(struct.unpack("<i", size)[0]), names)


def bam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Alignments with exon blocks, end, strand, number of hits and tags. A file that is cut short ends the query."""

    def run(batches):
        from itertools import islice

        from pyarrow import fs

        for batch in batches:
            for path in batch["path"].to_pylist():
                system, name = fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))
                with system.open_input_stream(name, compression=None) as raw:
                    rows = _records(raw)
                    while part := list(islice(rows, ROWS)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _KIND, strict=True)], schema=_KIND)

    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    files = files.repartitionByRange(max(1, spark.sparkContext.defaultParallelism), "length", "path")
    rows = files.select("path").mapInArrow(run, _OUT)
    return with_blocks(rows.withColumns({t.lower(): F.try_element_at("tags", F.lit(t)) for t in ("NH", "HI", "NM", "XS", "ts")}))


#: What a block's extra field begins with, the empty block at a file's end, bytes in a block.
_BLOCK_HEAD = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0"
_LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 0xFF00
#: Tags of whole numbers and of one letter; others are text.
_WHOLE, _LETTER = frozenset(("NH", "HI", "NM", "AS", "nM", "MQ")), frozenset(("XS", "ts"))


def block(data: bytes) -> bytes:
    """One block of a blocked gzip file, which any gzip reader reads too; at most ``BLOCK`` bytes."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    return _BLOCK_HEAD + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def blocks(data) -> bytes:
    """Bytes, or an iterator of bytes, as a whole blocked gzip file."""
    out, rest = [], b""
    for part in [data] if isinstance(data, bytes) else data:
        rest += part
        while len(rest) >= BLOCK:
            out.append(block(rest[:BLOCK]))
            rest = rest[BLOCK:]
    return b"".join([*out, *([block(rest)] if rest else []), _LAST_BLOCK])


def _bin(first: int, last: int) -> int:
    """The smallest cell of the 8-way tree over 2^29 bases that holds both places (from 0)."""
    for shift in (14, 17, 20, 23, 26):
        if first >> shift == last >> shift:
            return ((1 << (29 - shift)) - 1) // 7 + (first >> shift)
    return 0


def _tag(name: str, value: str) -> bytes:
    if name in _WHOLE and re.fullmatch(r"-?\d+", value):
        return name.encode() + b"i" + struct.pack("<i", int(value))
    if name in _LETTER and len(value) == 1:
        return name.encode() + b"A" + value.encode()
    return name.encode() + b"Z" + value.encode() + b"\0"


def _packed(r: dict, refs: dict[str, int]) -> bytes:
    ops = [(int(n), _OPS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", r["cigar"] or "")]
    seq = "" if r["seq"] in (None, "*") else r["seq"].upper()
    codes = [_BASES.index(c) if c in _BASES else 15 for c in seq] + [0] * (len(seq) % 2)
    qual = b"\xff" * len(seq) if r["qual"] in (None, "*") else bytes(ord(c) - 33 for c in r["qual"])
    ref, first = refs.get(r["contig"], -1), (r["start"] or 0) - 1
    span = sum(n for n, o in ops if _OPS[o] in "MDN=X")
    mate = ref if r["rnext"] == "=" else refs.get(r["rnext"], -1)
    name = (r["qname"] or "*").encode() + b"\0"
    tags = b"".join(_tag(k, v) for k, v in r["tags"] or () if v is not None)
    if len(ops) > 0xFFFF:  # more than the record's own field holds
        tags += b"CGBI" + struct.pack(f"<I{len(ops)}I", len(ops), *(n << 4 | o for n, o in ops))
        ops = [(len(seq), 4), (span, 3)]
    body = _HEAD.pack(ref, first, len(name), r["mapq"] or 0, _bin(max(first, 0), max(first, 0) + max(span,
        1) - 1), len(ops), r["flag"] or 0, len(seq), mate, (r["pnext"] or 0) - 1, r["tlen"] or 0) + name
    body += struct.pack(f"<{len(ops)}I", *(n << 4 | o for n, o in ops)) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + qual + tags
    return struct.pack("<i", len(body)) + body


def write_bam(alignments: DataFrame, path: str, contigs: list[tuple[str, int]]) -> int:
    """Writes one file for each partition, whole in itself, to a folder that all executors share; the number of rows.

    Columns as the reader gives them: qname, flag, contig, start, mapq, cigar, rnext, pnext, tlen, seq, qual and, if
    there, tags (a map of text). A contig outside the dictionary ``contigs`` (name, length) is none. A file takes its
    name when it is complete, so that a task that is run again leaves one file.
    """
    names = [f.name for f in _KIND]
    have = set(alignments.columns)
    cols = [F.col(n) if n in have else F.lit(None).cast(kind).alias(n) for n, kind in (x.split(" ", 1) for x in _OUT.split(", "))]
    refs = {name: k for k, (name, _) in enumerate(contigs)}
    text = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in contigs)
    head = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(contigs))
    head += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs)

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        system, folder = fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))
        system.create_dir(folder, recursive=True)
        staged, final = f"{folder}/.part-{task.partitionId():05d}-{task.taskAttemptId()}", f"{folder}/part-{task.partitionId():05d}.bam"
        rows, rest = 0, head
        with system.open_output_stream(staged, compression=None) as out:
            for batch in batches:
                for r in batch.to_pylist():
                    rest += _packed(r, refs)
                    rows += 1
                    while len(rest) >= BLOCK:
                        out.write(block(rest[:BLOCK]))
                        rest = rest[BLOCK:]
            out.write((block(rest) if rest else b"") + _LAST_BLOCK)
        system.move(staged, final)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["n"])

    return alignments.select(*cols).select(*names).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
