"""Graph-shaped steps: shared coverage, insert counts, components, paths over unitigs.

A path is an array of unitigs such as ``12F``: a name and the direction in which it is passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import revcomp
from .stored import discard, stored


def em_coverage(reads: DataFrame, targets: DataFrame, rounds: int, until: float | None = None) -> DataFrame:
    """(read, target, len) and (target, size): each read's bases go to its targets in proportion to
    1 + coverage, over and over; the first round deals evenly. Each round is two aggregations that
    combine before their shuffles and is written, so that plans don't grow; nothing is collected.
    With ``until``, stops early once no coverage moves by more."""
    cov = targets.select("target", "size", F.lit(0.0).alias("cov"))
    for k in range(rounds):
        weighed = reads.join(cov, "target").select("read", "target", "size", "len", (1 + F.col("cov")).alias("w"))
        total = weighed.groupBy("read").agg(F.sum("w").alias("total"))
        share = weighed.join(total, "read").groupBy("target").agg(F.sum(F.col("len") * F.col("w") / F.col("total") / F.col("size")).alias("new"))
        out = cov.join(share, "target", "left").select("target", "size", F.coalesce("new",
            F.lit(0.0)).alias("cov"), F.abs(F.coalesce("new", F.lit(0.0)) - F.col("cov")).alias("move"))
        if k == rounds - 1:
            return out.drop("move")
        out = stored(out)
        cov = out.drop("move")
        if until is not None and not out.filter(F.col("move") > until).limit(1).count():
            break
    return cov


def insert_counts(placements: DataFrame, least: int = 2) -> DataFrame:
    """Reads on each super-read; an odd mate beside its even mate on the same one does not count."""
    pair = F.floor(F.col("read") / 2)
    per = placements.groupBy("super", pair.alias("pair")).agg(F.count_if(F.col("read") % 2 == 0).alias("even"), F.count_if(F.col("read") % 2 == 1).alias("odd"))
    n = F.when(F.col("even") > 0, F.col("even")).otherwise(F.col("odd"))
    return per.groupBy("super").agg(F.sum(n).alias("count")).filter(F.col("count") >= least)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) undirected -> (node, component), the least node that can be reached.

    Each round takes the least label beside a node, then that label's own label, and is written.
    """
    e = edges.filter("a is not null and b is not null").select("a", "b")
    both = stored(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    found = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node",
        "m").alias("component"), F.lit(True).alias("moved")), "labels")
    before = None
    while found.filter("moved").limit(1).count():
        labels = found.select("node", "component")
        beside = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        near = labels.join(beside, "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("near"))
        top = labels.select(F.col("node").alias("near"), F.col("component").alias("top"))
        if before is not None:
            discard(before)
        before, found = found, stored(near.join(top, "near").select("node", F.least("near",
            "top").alias("component"), (F.least("near", "top") < F.col("was")).alias("moved")), "labels")
    discard(both)
    return found.select("node", "component")


def gene_clusters(exons: DataFrame) -> DataFrame:
    """(gene, contig, strand, start, end) -> (gene, cluster): genes whose exons overlap on one strand,
    over any number of steps; a gene alone is a cluster of its own.

    Exons are united into regions by a sweep first, and a gene is linked to its regions' least genes:
    the links are as many as exons at most, never pairs.
    """
    from .intervals import clusters

    marked = clusters(exons, 0, ("contig", "strand"), "region")
    at = ["contig", "strand", "region"]
    least = marked.groupBy(*at).agg(F.min("gene").alias("b"))
    return components(marked.join(least, at).select(F.col("gene").alias("a"), "b").distinct()).select(F.col("node").alias("gene"), F.col("component").alias("cluster"))


def flipped(path: Column) -> Column:
    """The same path read from its other end."""
    return F.transform(F.reverse(path), lambda u: F.concat(F.regexp_replace(u, "[FR]$", ""), F.translate(F.regexp_extract(u, "[FR]$", 0), "FR", "RF")))


def path_matches(reads: DataFrame, supers: DataFrame, both: bool = False, width: int = 4) -> DataFrame:
    """(id, path): where a read's path is a run of a super-read's: read, super, offset, and with
    ``both`` the direction F or R. Rows meet on a path's first ``width`` unitigs, all of a shorter path, so that
    a common unitig alone brings nothing together; the rest is compared in place."""
    r = reads.select(F.col("id").alias("read"), "path", F.lit("F").alias("direction"))
    if both:
        r = r.unionByName(r.select("read", flipped(F.col("path")).alias("path"), F.lit("R").alias("direction")))
    r = r.filter(F.size("path") > 0).withColumn("u", F.slice("path", 1, width))
    s = supers.select(F.col("id").alias("super"), F.col("path").alias("whole"), F.posexplode("path").alias("offset", "u_")).drop("u_")
    left = F.least(F.size("whole") - F.col("offset"), F.lit(width))
    s = s.select("super", "whole", "offset", F.explode(F.transform(F.sequence(F.lit(1), left), lambda n: F.slice("whole", F.col("offset") + 1, n))).alias("u"))
    hits = r.join(s, "u").filter(F.slice("whole", F.col("offset") + 1, F.size("path")) == F.col("path"))
    return hits.select("read", "super", "offset", *(["direction"] if both else []))


def reduced(paths: DataFrame, both: bool = False) -> DataFrame:
    """(id, path): paths that are a run of a longer one, with the least such container; with ``both``
    also its direction and offset there."""
    sizes = paths.select("id", F.size("path").alias("size"))
    x = path_matches(paths, paths, both).filter("read <> super")
    x = x.join(sizes.select(F.col("id").alias("read"), F.col("size").alias("a")),
        "read").join(sizes.select(F.col("id").alias("super"), F.col("size").alias("b")), "super")
    found = x.filter("b > a").groupBy("read")
    if not both:
        return found.agg(F.min("super").alias("container"))
    return found.agg(F.min(F.struct("super", "direction", "offset")).alias("m")).select("read", F.col("m.super").alias("container"),
        F.col("m.direction").alias("direction"), F.col("m.offset").alias("offset"))


def moved_placements(placements: DataFrame, reductions: DataFrame, good: DataFrame) -> DataFrame:
    """(read, super, offset, direction) after reductions (super, container, direction, shift): F adds
    the shift, R turns the read over; reads whose super-read is not among ``good`` (super) go."""
    m = reductions.select("super", "container", F.col("direction").alias("turn"), "shift")
    there = F.col("container").isNotNull()
    x = placements.join(m, "super", "left").select(
        "read",
        F.coalesce("container", "super").alias("super"),
        F.when(F.col("turn") == "R", F.col("shift") - F.col("offset")).when(there, F.col("offset") + F.col("shift")).otherwise(F.col("offset")).alias("offset"),
        F.when(F.col("turn") == "R", F.translate("direction", "FR", "RF")).otherwise(F.col("direction")).alias("direction"),
    )
    return x.join(good.select("super").distinct(), "super", "left_semi")


def path_sequences(paths: DataFrame, unitigs: DataFrame, k: int) -> DataFrame:
    """(id, path) and (unitig, seq): the sequence of each path, neighbours sharing k - 1 bases; a path
    with an unknown unitig has none."""
    steps = paths.select("id", F.size("path").alias("n"), F.posexplode("path").alias("i", "u"))
    steps = steps.select("id", "n", "i", F.regexp_replace("u", "[FR]$", "").alias("unitig"), F.col("u").endswith("R").alias("back"))
    seq = F.when(F.col("back"), revcomp(F.col("seq"))).otherwise(F.col("seq"))
    part = F.when(F.col("i") == 0, seq).otherwise(F.substring(seq, F.lit(k), F.length(seq)))
    found = steps.join(unitigs.select(F.col("unitig").cast("string").alias("unitig"), "seq"), "unitig").select("id", "n", "i", part.alias("part"))
    got = found.groupBy("id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "part"))).alias("parts")).filter(F.size("parts") == F.col("n"))
    return got.select("id", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("seq"))
