"""Text fields of annotation files and of read records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_decode(text: Column) -> Column:
    """Decodes %XX in one pass: %25 gives ``prc``, %3B a dot, codes up to a tab and above 7F a blank;
    other control codes stay as they are written."""
    code = lambda t: F.conv(F.substring(t, 2, 2), 16, 10).cast("int")

    def one(t):
        n = code(t)
        plain = F.when(n == 37, "prc").when(n == 59, ".").when((n <= 9) | (n > 127), " ").when(n < 32, t).otherwise(F.char(n))
        return F.when(t.rlike("^%[0-9A-Fa-f]{2}$"), plain).otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("%[0-9A-Fa-f]{2}|[^%]+|%"), 0), one), "")


def ensembl_id(name: Column, version: Column) -> Column:
    """An id without its kind (``gene:``) and with its version, if that is there and not in it yet."""
    bare = F.regexp_replace(name, "^(gene|transcript|CDS|exon):", "")
    return F.when(version.isNotNull() & ~F.endswith(bare, F.concat(F.lit("."), version)), F.concat_ws(".", bare, version)).otherwise(bare)


def reduce_attrs(own: Column, exons: Column) -> Column:
    """Attributes that all exons share move to the transcript, as ``exon_`` ones where it has another
    value; ``exon_id`` and ``exon_number`` are dropped. own: map, exons: array of maps."""
    first = F.element_at(exons, 1)
    shared = F.map_filter(first, lambda k, v: ~k.isin("exon_id", "exon_number") & F.forall(exons, lambda e: F.coalesce(F.try_element_at(e, k) == v, F.lit(False))))
    fresh = F.map_filter(shared, lambda k, v: F.try_element_at(own, k).isNull())
    other = F.transform_keys(F.map_filter(shared, lambda k, v: F.try_element_at(own, k) != v), lambda k, v: F.concat(F.lit("exon_"), k))
    return F.when(F.size(exons) > 0, F.map_concat(own, fresh, F.map_filter(other, lambda k, v: F.try_element_at(own, k).isNull()))).otherwise(own)


def sound_read(name: Column, seq: Column, qual: Column) -> Column:
    """(seq, qual) of a read whose lengths agree and whose bases are ACGTN, else the placeholder N."""
    ok = F.coalesce((F.length(seq) == F.length(qual)) & seq.rlike("^[ACGTNacgtn]+$"), F.lit(False))
    return F.struct(name.alias("name"), F.when(ok, seq).otherwise("N").alias("seq"), F.when(ok, qual).otherwise("!").alias("qual"))


def trim_homopolymer(seq: Column, least: int) -> Column:
    """Cuts a repetitive end: from the end on, a base like its neighbour scores 1, another -1; the
    best score's stretch (the shortest such) goes if it reaches ``least``, one base of it staying."""
    back = F.split(F.reverse(seq), "")
    kind = "struct<score:int,best:int,cut:int,at:int,last:string>"
    zero = F.struct(F.lit(0).alias("score"), F.lit(0).alias("best"), F.lit(0).alias("cut"), F.lit(0).alias("at"), F.element_at(back, 1).alias("last")).cast(kind)

    def step(a, c):
        score = a["score"] + F.when(c == a["last"], 1).otherwise(-1)
        best = score > a["best"]
        return F.struct(score.alias("score"), F.when(best, score).otherwise(a["best"]).alias("best"), F.when(best,
            a["at"] + 1).otherwise(a["cut"]).alias("cut"), (a["at"] + 1).alias("at"), c.alias("last")).cast(kind)

    end = F.aggregate(F.slice(back, 2, F.greatest(F.size(back) - 1, F.lit(0))), zero, step)
    cut = F.when(end["best"] >= least, end["cut"]).otherwise(0)
    return F.when(F.length(seq) > 1, F.substring(seq, F.lit(1), F.length(seq) - cut)).otherwise(seq)
