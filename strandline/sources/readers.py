"""Text formats as DataFrames: SAM, GTF/GFF3, BED, FASTA, VCF and point features.

All read through Spark, so every path and codec that Spark reads will do; parsing is built-in
expressions, which Catalyst prunes to the columns a query needs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sam import end_pos, exons, hits, splice_strand


def _sound(lines: DataFrame, comment: str) -> DataFrame:
    return lines.filter((F.col("value") != "") & ~F.col("value").startswith(comment))


def _field(parts: Column, k: int, kind: str = "string") -> Column:
    return F.nullif(F.try_element_at(parts, F.lit(k + 1)), F.lit(".")).try_cast(kind) if kind != "string" else F.nullif(F.try_element_at(parts, F.lit(k + 1)), F.lit("."))


def _tag(parts: Column, tag: str) -> Column:
    hit = F.filter(parts, lambda x: x.startswith(tag + ":"))
    return F.when(F.size(hit) > 0, F.substring_index(F.element_at(hit, 1), ":", -1))


def sam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_sam(spark.read.text(paths))


def parse_sam(lines: DataFrame) -> DataFrame:
    """Lines (value) as alignments with exon blocks, end, strand and number of hits."""
    p = F.split("value", "\t")
    names = (("qname", "string"), ("flag", "int"), ("contig", "string"), ("start", "long"), ("mapq", "int"), ("cigar", "string"), ("rnext",
        "string"), ("pnext", "long"), ("tlen", "long"), ("seq", "string"), ("qual", "string"))
    rows = _sound(lines, "@").select(*(F.element_at(p, k + 1).cast(t).alias(n) for k, (n, t) in enumerate(names)),
        *(_tag(p, t).alias(t.lower()) for t in ("NH", "HI", "NM", "XS", "ts")))
    return with_blocks(rows)


def with_blocks(rows: DataFrame) -> DataFrame:
    """Alignments with their number of hits, end, exon blocks and strand."""
    start, cigar = F.col("start"), F.col("cigar")
    return rows.withColumns({"nh": hits(F.col("nh").cast("int")), "end": end_pos(start, cigar), "exons": exons(start, cigar),
        "strand": splice_strand(F.col("xs"), F.col("ts"), F.col("flag"))})


def header_sequences(lines: DataFrame) -> DataFrame:
    """contig, length and the other fields of each ``@SQ`` line of alignment headers."""
    p = F.split("value", "\t")
    pairs = F.transform(F.filter(p, lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:")),
        lambda x: F.struct(F.substring(x, 1, 2).alias("key"), F.substring(x, 4, 1 << 20).alias("value")))
    tags = lines.filter(F.col("value").startswith("@SQ\t")).select(F.map_from_entries(_first_of_each(pairs)).alias("tags"))
    return tags.select(F.try_element_at("tags", F.lit("SN")).alias("contig"), F.try_element_at("tags",
        F.lit("LN")).try_cast("long").alias("length"), F.map_filter("tags", lambda k, v: ~k.isin("SN", "LN")).alias("tags"))


def super_reads(alignments: DataFrame) -> DataFrame:
    """(qname, flag, seq) -> super, size: alignments that are mapped, primary and whole, one a super-read
    (the shortest, of several)."""
    sound = alignments.filter(F.col("flag").bitwiseAND(0x904) == 0)
    return sound.groupBy(F.col("qname").try_cast("long").alias("super")).agg(F.min(F.length("seq")).cast("long").alias("size"))


def listed_paths(spark: SparkSession, path: str) -> list[str]:
    """The paths that a list file names, one a line; comments and lines of one character are none."""
    rows = spark.read.text(path).filter("length(trim(value)) > 1 and not trim(value) like '#%'").collect()
    return [r["value"].strip() for r in rows]


def sample_paths(spark: SparkSession, path: str, pattern: str = ".") -> list[tuple[str, str]]:
    """(sample, path) of GTF files: of a list file's lines ``sample path``, or of a folder whose subfolders
    with a name that has the pattern are samples. An odd line, a sample named twice or no file is an error.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(fs_path) and fs.getFileStatus(fs_path).isFile():
        out = [tuple(r["value"].split()) for r in spark.read.text(path).filter("trim(value) <> '' and not value like '#%'").collect()]
        bad = [x for x in out if len(x) != 2]
        if bad:
            raise ValueError(f"a line should have a sample and a path: {' '.join(bad[0])}")
    else:
        folders = [s.getPath() for s in fs.listStatus(fs_path) if s.isDirectory()] if fs.exists(fs_path) else []
        out = [(d.getName(), f.getPath().toString()) for d in folders if re.search(pattern,
            d.getName()) for f in fs.listStatus(d) if f.getPath().getName().endswith(".gtf")]
    if len({x[0] for x in out}) < len(out):
        raise ValueError("a sample is named twice")
    if not out:
        raise ValueError(f"no files of samples in {path}")
    return sorted(out)


def gff(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_gff(spark.read.text(paths))


def parse_gff(lines: DataFrame) -> DataFrame:
    """GTF or GFF3 rows; a line tells its own dialect by its attributes."""
    p = F.split("value", "\t")
    text = F.element_at(p, 9)
    three = F.transform(F.regexp_extract_all(text, F.lit(r"([^=;\s]+)=([^;]*)"), 0),
        lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.substring(x, F.instr(x, "=") + 1, F.length(x)).alias("value")))
    two = F.transform(F.regexp_extract_all(text, F.lit(r'(\w+)\s+("[^"]*"|[^";\s]+)'), 0),
        lambda x: F.struct(F.regexp_extract(x, r"^\w+", 0).alias("key"), F.trim(F.regexp_replace(x, r"^\w+\s+", ""), F.lit('"')).alias("value")))
    attrs = F.map_from_entries(_first_of_each(F.when(text.rlike(r'^\s*[^=;\s"]+='), three).otherwise(two)))
    rows = _sound(lines, "#").select(
        F.element_at(p, 1).alias("contig"), _field(p, 1).alias("source"), F.element_at(p, 3).alias("feature"),
            F.element_at(p, 4).cast("long").alias("start"), F.element_at(p, 5).cast("long").alias("end"),
        _field(p, 5, "double").alias("score"), F.element_at(p, 7).alias("strand"), _field(p, 7).alias("phase"), attrs.alias("attrs"),
    )
    get = lambda k: F.try_element_at("attrs", F.lit(k))
    return rows.withColumns({"transcript_id": F.coalesce(get("transcript_id"), F.when(F.col("feature").isin("exon", "CDS"),
        get("Parent")).otherwise(get("ID"))), "gene_id": F.coalesce(get("gene_id"), get("geneID"))})


def _first_of_each(entries: Column) -> Column:
    # entries and keys are bound by a lambda each: named from within the filter's, they would be made again for every entry
    bind = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    firsts = lambda es, keys: F.filter(es, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    return bind(entries, lambda es: bind(F.transform(es, lambda e: e["key"]), lambda keys: firsts(es, keys)))


def bed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_bed(spark.read.text(paths))


def parse_bed(lines: DataFrame) -> DataFrame:
    """BED lines with 1-based starts; blocks, if any, become exons, and a 13th column ``k=v;`` attributes."""
    p = F.split("value", "\t")
    rows = _sound(lines, "#").filter("not value rlike '^(browser|track)'")
    start = F.element_at(p, 2).cast("long")
    numbers = lambda k: F.transform(F.filter(F.split(F.try_element_at(p, F.lit(k)), ","), lambda x: x != ""), lambda x: x.cast("long"))
    blocks = F.zip_with(numbers(12), numbers(11), lambda at, n: F.struct((start + at + 1).alias("start"), (start + at + n).alias("end")))
    whole = F.array(F.struct((start + 1).alias("start"), F.element_at(p, 3).cast("long").alias("end")))
    pairs = F.transform(F.filter(F.split(F.coalesce(F.try_element_at(p, F.lit(13)), F.lit("")), ";"),
        lambda x: F.instr(x, "=") > 0), lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"),
        F.substring(x, F.instr(x, "=") + 1, F.length(x)).alias("value")))
    attrs = F.map_from_entries(_first_of_each(pairs))
    return rows.select(F.element_at(p, 1).alias("contig"), (start + 1).alias("start"), F.element_at(p, 3).cast("long").alias("end"),
        _field(p, 3).alias("name"), _field(p, 4, "double").alias("score"), F.coalesce(F.try_element_at(p, F.lit(6)), F.lit(".")).alias("strand"),
        F.coalesce(blocks, whole).alias("exons"), attrs.alias("attrs"))


def fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records: name, header, seq."""
    return parse_fasta(spark.read.option("lineSep", "\n>").text(paths))


def parse_fasta(rows: DataFrame) -> DataFrame:
    """Records (value: header, line end, lines; with or without ``>``) as name, header, seq."""
    text = F.regexp_replace("value", r"^>", "")
    header = F.substring_index(text, "\n", 1)
    body = F.when(F.instr(text, "\n") > 0, F.substring(text, F.instr(text, "\n") + 1, F.length(text))).otherwise("")
    return rows.filter("value <> ''").select(F.regexp_extract(header, r"^\S*",
        0).alias("name"), F.rtrim(header).alias("header"), F.regexp_replace(body, r"[\s>]+", "").alias("seq"))


def vcf(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_vcf(spark.read.text(paths))


def parse_vcf(lines: DataFrame) -> DataFrame:
    """Variant lines: alternatives, filters and samples as arrays, INFO as a map."""
    p = F.split("value", "\t")
    info = F.map_from_entries(_first_of_each(F.transform(F.filter(F.split(F.element_at(p, 8), ";"),
        lambda x: (x != "") & (x != ".")), lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"),
        F.when(F.instr(x, "=") > 0, F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("value")))))
    return _sound(lines, "#").select(
        F.element_at(p, 1).alias("chrom"), F.element_at(p, 2).cast("long").alias("pos"), _field(p, 2).alias("id"), F.element_at(p,
            4).alias("ref"), F.filter(F.split(F.element_at(p, 5), ","), lambda x: x != ".").alias("alts"),
        _field(p, 5, "double").alias("qual"), F.split(_field(p, 6), ";").alias("filters"), info.alias("info"),
            F.slice(p, 10, F.greatest(F.size(p) - 9, F.lit(0))).alias("samples"),
    )


def points(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_points(spark.read.text(paths))


def parse_points(lines: DataFrame) -> DataFrame:
    """contig, coord, strand, type; a line of another shape ends the query."""
    p = F.split("value", "\\s+")
    sound = (F.size(p) >= 4) & F.element_at(p, 4).isin("TSS", "CPAS", "JSTART", "JEND") & F.element_at(p, 2).rlike(r"^\d+$") & F.element_at(p, 3).isin("+", "-", ".")
    checked = F.when(sound, F.element_at(p, 1)).otherwise(F.raise_error(F.concat(F.lit("bad point feature: "), F.col("value"))).cast("string"))
    return _sound(lines, "#").select(checked.alias("contig"), F.element_at(p, 2).try_cast("long").alias("coord"), F.element_at(p,
        3).alias("strand"), F.element_at(p, 4).alias("type"))


def merged_inputs(*frames: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """Several inputs in one, tagged with their number, in coordinate order: contigs by name, or by their
    place in a dictionary ``contigs`` (contig, ord)."""
    tagged = [f.withColumn("file_idx", F.lit(k)) for k, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    if contigs is None:
        return out.orderBy("contig", "start", "end", "file_idx")
    return out.join(contigs.select("contig", "ord"), "contig", "left").orderBy(F.col("ord").asc_nulls_last(), "contig", "start", "end", "file_idx").drop("ord")


def tlf(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_tlf(spark.read.text(paths))


def parse_tlf(lines: DataFrame) -> DataFrame:
    """Transcript lines: one row a transcript, its exons in the attribute ``exons=1-10,20-30`` and its
    coding span in ``CDS=5:25``; lines without exons are left out."""
    rows = parse_gff(lines).withColumn("list_", F.try_element_at("attrs", F.lit("exons"))).filter("list_ is not null")
    cds = F.split(F.try_element_at("attrs", F.lit("CDS")), "[:,-]")
    spans = F.transform(F.split("list_", ","), lambda x: F.struct(F.substring_index(x, "-", 1).cast("long").alias("start"),
        F.substring_index(x, "-", -1).cast("long").alias("end")))
    return rows.withColumns({"exons": F.array_sort(spans), "cds_start": F.try_element_at(cds, F.lit(1)).try_cast("long"),
        "cds_end": F.try_element_at(cds, F.lit(-1)).try_cast("long")}).drop("list_")


def _fastq_ranges(spark: SparkSession, paths: list[str], span: int) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    packed_ = F.col("path").rlike(r"\.(gz|bz2)$")
    cuts = F.when(packed_, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1,
        F.lit(0)), F.lit(span).cast("long")))
    ranges = files.select("path", F.explode(cuts).alias("at"), F.when(packed_, F.lit(1 << 62)).otherwise(F.lit(span)).cast("long").alias("span"))
    return ranges.repartition(max(1, spark.sparkContext.defaultParallelism), "path", "at")


def fastq(spark: SparkSession, paths: str | list[str], span: int = 64 << 20) -> DataFrame:
    """FASTQ records of four lines: path, at (byte of the record), name, header, seq, qual.

    Files are read in ranges of ``span`` bytes, each from its first record on; a packed file is one
    range. A range's first record is the first line with ``@`` whose second next has ``+`` and whose
    sequence and quality agree in length, as ``@`` may also begin a quality line.
    """
    import pyarrow as pa

    def lines(path: str, at: int):
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))
        with system.open_input_stream(name) if name.endswith((".gz", ".bz2")) else system.open_input_file(name) as raw:
            if at:
                raw.seek(at - 1)
            rest, pos = b"", max(at - 1, 0)
            while block := raw.read(1 << 20):
                *whole, rest = (rest + block).split(b"\n")
                for line in whole:
                    yield pos, line.removesuffix(b"\r")
                    pos += len(line) + 1
            if rest:
                yield pos, rest.removesuffix(b"\r")

    def records(path: str, at: int, span: int):
        held = []
        feed = lines(path, at)
        if at:
            next(feed, None)  # the end of a line that began in the range before
        for pos, line in feed:
            held.append((pos, line))
            if len(held) < 4:
                continue
            (begin, head), (_, seq), (_, plus), (_, qual) = held
            if head[:1] == b"@" and plus[:1] == b"+" and len(seq) == len(qual):
                if begin >= at + span:
                    return
                yield begin, head[1:].decode(), seq.decode(), qual.decode()
                held = []
            else:
                held.pop(0)

    def run(batches):
        schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("header", pa.string()), ("seq", pa.string()), ("qual", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                for r in records(row["path"], row["at"], row["span"]):
                    out.append((row["path"], *r))
                    if len(out) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    ranges = _fastq_ranges(spark, [paths] if isinstance(paths, str) else paths, span)
    rows = ranges.mapInArrow(run, "path string, at long, header string, seq string, qual string")
    return rows.select("path", "at", F.regexp_extract("header", r"^\S*", 0).alias("name"), "header", "seq", "qual")
