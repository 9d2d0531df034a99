"""Tools for ordered records: head, tail, splits, samples, extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows, or with n < 0 all but the last -n."""
    if n >= 0:
        return df.orderBy(*order).limit(n)
    last = df.orderBy(*(F.desc(c) for c in order)).limit(-n).select(*order)
    return df.join(last, list(order), "left_anti")


def tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*(F.desc(c) for c in order)).limit(n)


def split_round_robin(df: DataFrame, parts: int, key: str) -> DataFrame:
    """Deals a dense integer key to parts in turn, without ranking all rows."""
    return df.withColumn("part", F.pmod(F.col(key), F.lit(parts)))


def extract(df: DataFrame, names: DataFrame, key: str, invert: bool = False) -> DataFrame:
    return df.join(names, key, "left_anti" if invert else "left_semi")


def grep(df: DataFrame, column: str, pattern: str, invert: bool = False, most: int | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose column has the pattern, or with ``invert`` has not; ``most`` keeps the first so many by
    ``order``: the option of a search that stops early."""
    hit = F.coalesce(F.col(column).rlike(pattern), F.lit(False))
    found = df.filter(~hit if invert else hit)
    return found if most is None else found.orderBy(*order).limit(most)


def grep_lines(df: DataFrame, column: str, pattern: str, invert: bool = False) -> DataFrame:
    """Records with only those lines of a text column that have the pattern (or have not); records
    without one go."""
    lines = F.filter(F.split(column, "\n"), lambda x: ~x.rlike(pattern) if invert else x.rlike(pattern))
    return df.withColumn(column, lines).filter(F.size(column) > 0).withColumn(column, F.array_join(column, "\n"))


def sorted_lines(df: DataFrame, column: str) -> DataFrame:
    """Each record's lines in order."""
    return df.withColumn(column, F.array_join(F.array_sort(F.split(column, "\n")), "\n"))


def from_nth(df: DataFrame, n: int, *order: str) -> DataFrame:
    """All rows from the n-th (from 1) on."""
    if n <= 1:
        return df.orderBy(*order)
    # the rows ahead are few and tell where the rest begins; an offset would take all rows through one task
    key = F.struct(*order)
    ahead = df.orderBy(*order).limit(n - 1).groupBy(key.alias("edge_")).agg(F.count("*").alias("skip_"))
    edge = F.broadcast(ahead.agg(F.max_by(F.struct("edge_", "skip_"), "edge_").alias("e_")))  # one row
    rows = df.crossJoin(edge).filter(key >= F.col("e_.edge_"))
    beyond = rows.filter(key > F.col("e_.edge_"))
    ties = rows.filter(key == F.col("e_.edge_")).withColumn("k_", F.row_number().over(Window.partitionBy(*order).orderBy(*order)))
    return beyond.select(*df.columns).unionByName(ties.filter(F.col("k_") > F.col("e_.skip_")).select(*df.columns)).orderBy(*order)


def head_bytes(df: DataFrame, n: int, size: str, *order: str) -> DataFrame:
    """The first rows whose sizes sum to at most n; a row has a byte at least, so n rows are enough to sum."""
    few = df.orderBy(*order).limit(n)
    run = F.sum(F.greatest(F.col(size), F.lit(1))).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return few.withColumn("run_", run).filter(F.col("run_") <= n).drop("run_")


def in_bytes(df: DataFrame, first: int, last: int, at: str = "at") -> DataFrame:
    """Records that begin within a range of bytes of their file."""
    return df.filter(F.col(at).between(first, last))


def with_offsets(df: DataFrame, order: str, size: str, name: str = "at", block: int = 1 << 16) -> DataFrame:
    """Adds the sum of the sizes of all rows before, by an integer column without repeats. Sums run
    within a block of that column, on top of the blocks before it."""
    rows = df.withColumn("block_", F.floor(F.col(order) / block))
    sizes = rows.groupBy("block_").agg(F.sum(size).alias("n_"))
    base = sizes.select("block_", F.coalesce(F.sum("n_").over(Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base_"))
    before = F.coalesce(F.sum(size).over(Window.partitionBy("block_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("run_", before).join(base, "block_").withColumn(name, (F.col("base_") + F.col("run_")).cast("long")).drop("block_", "run_", "base_")


def by_place(tx: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """Transcripts by contig (its name, or its place in a dictionary: contig, ord), start, level, end and id."""
    keys = ["contig", "start", "level", "end", "id"]
    if contigs is None:
        return tx.orderBy(*keys)
    return tx.join(contigs.select("contig", "ord"), "contig", "left").orderBy(F.col("ord").asc_nulls_last(), *keys).drop("ord")


def add_missing_mates(reads: DataFrame) -> DataFrame:
    """Reads 2i and 2i + 1 are mates; one without the other gets a mate ``N``."""
    ids = reads.select(F.explode(F.array("id", F.col("id").bitwiseXOR(F.lit(1)))).alias("id")).distinct()
    return ids.join(reads.select("id", "seq"), "id", "left").select("id", F.coalesce("seq", F.lit("N")).alias("seq"))


def collapse(reads: DataFrame, *alike: str, read: str = "read") -> DataFrame:
    """Alignments alike in some columns as one: these columns, read_count and first_<read>."""
    return reads.groupBy(*alike).agg(F.count("*").alias("read_count"), F.min(read).alias(f"first_{read}"))


def pair_links(reads: DataFrame, pairs: DataFrame, *alike: str, read: str = "read") -> DataFrame:
    """(a, b) mates -> a, b, pairs: how many pairs link two collapsed alignments, named by their first reads."""
    named = reads.join(collapse(reads, *alike, read=read).drop("read_count"), list(alike)).select(F.col(read).alias("r_"), F.col(f"first_{read}").alias("f_"))
    x = pairs.join(named.select(F.col("r_").alias("a"), F.col("f_").alias("fa_")), "a").join(named.select(F.col("r_").alias("b"), F.col("f_").alias("fb_")), "b")
    return x.groupBy(F.least("fa_", "fb_").alias("a"), F.greatest("fa_", "fb_").alias("b")).agg(F.count("*").alias("pairs"))


def last_per_group(df: DataFrame, key: str, *order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return df.withColumn("rank_", rank).filter("rank_ = 1").drop("rank_")


def places(df: DataFrame, by: str, lead: Column, block: int = 1 << 16) -> DataFrame:
    """Adds the place (rank) of each row by a column whose leading part, ``lead``, is a number.

    Values are counted first. Ranks come from a block of leading numbers on top of the sizes of the
    blocks before it: the one window over everything sees one row a block.
    """
    counts = df.groupBy(by, F.floor(lead / block).alias("block_")).agg(F.count("*").alias("n_"))
    blocks = counts.groupBy("block_").agg(F.sum("n_").alias("size_"))
    base = blocks.select("block_", F.coalesce(F.sum("size_").over(Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy("block_").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.join(base, "block_").select(by, (F.col("base_") + before + 1).alias("place"))
    return df.join(ranks, by)


def interleave(first: DataFrame, second: DataFrame, at: str = "ord") -> DataFrame:
    """Mates in turn: row n of the first input becomes 2n, of the second 2n + 1; a row without its mate
    ends the query."""
    a, b = (f.select(F.col(at), F.struct(*(f[c] for c in f.columns if c != at)).alias(n)) for f, n in ((first, "a"), (second, "b")))
    both = a.join(b, at, "full")
    whole = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.array("a", "b")).otherwise(F.raise_error(F.concat(F.lit("no mate at "), F.col(at).cast("string"))))
    return both.select(F.col(at), F.posexplode(whole).alias("mate", "row")).select((F.col(at) * 2 + F.col("mate")).alias(at), "row.*")


def order_keys(column: str, how: str = "text", seed: int = 0) -> list[Column]:
    """Sort keys of a header: as text, without case, by its first number (none comes last), or at random."""
    c = F.col(column)
    number = F.nullif(F.regexp_extract(c, r"-?\d+(?:\.\d+)?", 0), F.lit("")).cast("double")
    keys = {"text": [c], "nocase": [F.lower(c), c], "number": [number.asc_nulls_last(), c], "random": [F.xxhash64(c, F.lit(seed)), c]}
    return keys[how]


def ordered(df: DataFrame, column: str, how: str = "text", seed: int = 0) -> DataFrame:
    """Sorted by a header, in the ways of ``order_keys``."""
    return df.orderBy(*order_keys(column, how, seed))


def sample(df: DataFrame, share: float, seed: int, invert: bool = False) -> DataFrame:
    """A Bernoulli sample, or what it leaves; the same rows for the same seed and partitions."""
    hit = F.rand(seed) < share
    return df.filter(~hit if invert else hit)
