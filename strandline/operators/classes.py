"""Class codes: how a transcript relates to another, and which code of a transcript comes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import exon_overlap, exons_len, introns
from .intervals import overlap_join

#: The order in which codes are preferred; what has no code ranks behind all.
RANK = {"=": 0, "~": 1, ":": 2, "_": 3, "c": 4, "k": 4, "m": 6, "n": 6, "j": 6, "e": 12, "o": 12, "s": 16, "x": 18, "i": 20, "y": 30, "p": 90, "r": 92, "u": 94}
#: Fixed value: bases by which an end may poke into an intron or out of an exon, less one.
POKE = 4
_NEVER = 1 << 30


def code_rank(code: Column) -> Column:
    """The rank of a code, 96 for one that is not known and 100 for null."""
    table = F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair])
    return F.when(code.isNull(), 100).otherwise(F.coalesce(F.try_element_at(table, code), F.lit(96)))


def _first(flags: Column) -> Column:
    """The place of the first true, far behind all for none."""
    return F.coalesce(F.nullif(F.array_position(flags, True), F.lit(0)), F.lit(_NEVER))


def _run_at(part: Column, whole: Column) -> Column:
    """Where the array ``part`` is a run of ``whole``, from 1; 0 where it is none."""
    at = F.array_position(whole, F.get(part, F.lit(0))).cast("int")
    return F.when((at > 0) & (F.slice(whole, F.greatest(at, F.lit(1)), F.greatest(F.size(part), F.lit(1))) == part), at).otherwise(0)


def _single_pair(m: Column, r: Column, reach: int, ends: bool) -> Column:
    x, y = F.get(m, F.lit(0)), F.get(r, F.lit(0))
    a, b, common = exons_len(m), exons_len(r), exon_overlap(m, r)
    same = (F.abs(x["start"] - y["start"]) <= reach) & (F.abs(x["end"] - y["end"]) <= reach)
    near = F.when(a > b, (common >= 0.8 * a) | ((common >= 0.8 * b) & (common >= 0.7 * a))).otherwise(common >= 0.8 * b)
    plain = F.when((a < b) & (common >= 0.8 * a), "c").when((a >= b) & (common >= 0.8 * b), "k").otherwise("o")
    return F.when(same, "=").when(near, "~").otherwise(plain) if ends else plain


def _single_on_many(m: Column, r: Column, chain: Column) -> Column:
    s, e = F.get(m, F.lit(0))["start"], F.get(m, F.lit(0))["end"]
    in_exon = _first(F.transform(r, lambda y: (s <= y["end"]) & (y["start"] <= e) & (s > y["start"] - POKE) & (e < y["end"] + POKE)))
    over = _first(F.transform(chain, lambda i: (s < i["start"] - 1) & (e > i["end"] + 1)))
    inside = _first(F.transform(chain, lambda i: (s >= i["start"]) & (e <= i["end"])))
    part = F.exists(chain, lambda i: (F.least(e, i["end"]) - F.greatest(s, i["start"]) + 1 >= 10) & (e - s + 1 > F.least(e, i["end"]) - F.greatest(s, i["start"]) + 11))
    spans = (s <= F.get(r, F.lit(0))["end"]) & (e >= F.element_at(r, -1)["start"])
    return F.when(spans, "m").when((in_exon < _NEVER) & (in_exon <= F.least(over,
        inside)), "c").when(over < inside, "n").when(inside < _NEVER, "i").when(part, "e").otherwise("o")


def _many_on_single(m: Column, r: Column, chain: Column) -> Column:
    s, e = F.get(r, F.lit(0))["start"], F.get(r, F.lit(0))["end"]
    held = _first(F.transform(m, lambda x: (s <= x["end"]) & (x["start"] <= e) & (s > x["start"] - POKE) & (e < x["end"] + POKE)))
    inside = _first(F.transform(chain, lambda i: (s >= i["start"]) & (e <= i["end"])))
    return F.when((held < _NEVER) & (held <= inside), "k").when(inside < _NEVER, "y").otherwise("o")


def _poke(beyond: Column, at: Column, from_left: bool) -> Column:
    """By how many bases an end lies inside one of the introns that a shared run leaves out."""
    depth = lambda i: i["end"] + 1 - at if from_left else at - i["start"] + 1
    return F.coalesce(F.array_max(F.transform(F.filter(beyond, lambda i: (i["start"] <= at) & (at <= i["end"])), depth)), F.lit(0))


def _crossed(beyond: Column, at: Column, from_left: bool) -> Column:
    """Whether an exon runs through one of the introns that a shared run leaves out."""
    return F.exists(beyond, lambda i: (at < i["start"]) if from_left else (at > i["end"]))


def _many_on_many(m: Column, r: Column, im: Column, ir: Column, reach: int) -> Column:
    ms, me, rs, re = F.get(m, F.lit(0))["start"], F.element_at(m, -1)["end"], F.get(r, F.lit(0))["start"], F.element_at(r, -1)["end"]
    m_first, m_last, r_first, r_last = F.get(m, F.lit(0)), F.element_at(m, -1), F.get(r, F.lit(0)), F.element_at(r, -1)
    inside = F.exists(ir, lambda i: (ms >= i["start"]) & (me <= i["end"]))
    before, behind = m_last["start"] < r_first["end"], r_last["start"] < m_first["end"]
    plugs = F.when(before, m_last["end"] >= F.get(r, F.lit(1))["start"]).otherwise(m_first["start"] <= F.element_at(r, -2)["end"])
    same = F.when((F.abs(rs - ms) <= reach) & (F.abs(re - me) <= reach), "=").otherwise("~")
    # one chain as a run of the other: what ends do in the introns left out
    at_r, at_m = _run_at(im, ir), _run_at(ir, im)
    left_r, right_r = F.slice(ir, 1, F.greatest(at_r - 1, F.lit(0))), F.slice(ir, F.greatest(at_r + F.size(im), F.lit(1)), F.size(ir))
    left_m, right_m = F.slice(im, 1, F.greatest(at_m - 1, F.lit(0))), F.slice(im, F.greatest(at_m + F.size(ir), F.lit(1)), F.size(im))
    keeps = (at_r > 0) & (_crossed(left_r, ms, True) | _crossed(right_r, me, False))
    poke_m = F.when(at_r > 0, F.greatest(_poke(left_r, ms, True), _poke(right_r, me, False))).otherwise(0)
    in_m = (at_m > 0) & ~(_crossed(left_m, rs, True) | _crossed(right_m, re, False))
    poke_r = F.when((at_m > 0) & (at_r == 0), F.greatest(_poke(left_m, rs, True), _poke(right_m, re, False))).otherwise(0)
    # introns of r within an exon of m; behind m's last intron only the next counts, unless one of r ends with it or later
    body, last = F.slice(m, 1, F.size(m) - 1), F.element_at(im, -1)
    within = F.exists(ir, lambda i: F.exists(body, lambda x: (x["start"] < i["start"]) & (i["end"] < x["end"])))
    blocked = F.exists(ir, lambda i: (i["start"] - 2 <= last["end"]) & (i["end"] >= last["end"]))
    following = F.get(F.filter(ir, lambda i: i["start"] - 2 > last["end"]), F.lit(0))
    kept = within | (~blocked & F.coalesce(following["end"] < me, F.lit(False))) | keeps
    # introns of m that r has not, over r's span; behind r's last intron only if m has not that one
    tail = F.element_at(ir, -1)
    conflict = F.exists(im, lambda i: ~F.array_contains(ir, i) & (i["start"] <= re) & (rs <= i["end"]) & ~(F.array_contains(im, tail) & (i["start"] > tail["end"])))
    site = F.arrays_overlap(F.transform(im, lambda i: i["start"]),
        F.transform(ir, lambda i: i["start"])) | F.arrays_overlap(F.transform(im, lambda i: i["end"]), F.transform(ir, lambda i: i["end"]))
    return (
        F.when(inside, "i")
        .when(before | behind, F.when(plugs, "n").otherwise("o"))
        .when(im == ir, same)
        .when((at_r > 0) & ~keeps & (poke_m < POKE), "c")
        .when((at_r == 0) & in_m & (poke_r < POKE), "k")
        .when(kept, F.when(~conflict & (poke_r < POKE) & (poke_m < POKE), "m").otherwise("n"))
        .when(site, "j")
        .when(exon_overlap(m, r) > 4, "o")
        .when((ms > rs) & (re > me), "i")
        .otherwise("y")
    )


def class_code(m: Column, r: Column, reach: int = 0, single_ends: bool = True, im: Column | None = None, ir: Column | None = None) -> Column:
    """How transcript m (sorted exons) relates to r, whatever their strands; a dot where they lie apart.
    Their introns, im and ir, may be given as columns that are there already; that spares much work.

    = and ~: one intron chain, ends within reach or not; of single exons: ends within reach, or 80 % of the
    longer shared. c, k: m is contained in r, or r in m, exon ends poking at most three bases into an intron;
    of single exons: 80 % of the shorter shared. m, n: introns of r are kept unspliced, without or with
    conflict. j: a shared splice site. e: a single exon that runs at least ten bases into an intron. i, y:
    one lies in an intron of the other. o: any other overlap of exons. ``single_ends`` False leaves out
    = and ~ of single exons, so that equal ones are k.
    """
    apart = (F.element_at(m, -1)["end"] < F.get(r, F.lit(0))["start"]) | (F.element_at(r, -1)["end"] < F.get(m, F.lit(0))["start"])
    one_m, one_r = F.size(m) == 1, F.size(r) == 1
    im, ir = introns(m) if im is None else im, introns(r) if ir is None else ir
    single = F.when(one_m & one_r, _single_pair(m, r, reach, single_ends)).when(one_m, _single_on_many(m, r, ir)).otherwise(_many_on_single(m, r, im))
    return F.when(apart, ".").when(one_m | one_r, single).otherwise(_many_on_many(m, r, im, ir, reach))


def coding_code(code: Column, same_cds: Column) -> Column:
    """``=`` and ``~`` of transcripts whose coding ends differ: ``:`` and ``_``."""
    return F.when(~same_cds & (code == "="), ":").when(~same_cds & (code == "~"), "_").otherwise(code)


def classify(queries: DataFrame, refs: DataFrame, run: int = 2000, reach: int = 0, repeats: float = 0.5) -> DataFrame:
    """(id, contig, strand, start, end, exons) twice -> id, code, ref: the best code of each query.

    On opposite strands an overlap of introns is s and one of exons x. Without an overlap: p within ``run``
    bases behind a reference of its strand, in reading direction; r with a ``repeat_share`` (a column of the
    queries, if there) of at least ``repeats``; u otherwise. Codes go by rank, then by shared bases, then the
    least reference.
    """
    keep = ["id", "contig", "strand", "start", "end", "exons", introns(F.col("exons")).alias("introns")]
    pairs = overlap_join(queries.select(*keep), refs.select(*keep), slack=run)
    m, r, im, ir = (F.col(c) for c in ("a_exons", "b_exons", "a_introns", "b_introns"))
    meets = lambda a, b: F.exists(a, lambda i: F.exists(b, lambda j: (i["start"] <= j["end"]) & (j["start"] <= i["end"])))
    plain = class_code(m, r, reach, im=im, ir=ir)
    opposite = F.col("a_strand").isin("+", "-") & F.col("b_strand").isin("+", "-") & (F.col("a_strand") != F.col("b_strand"))
    behind = F.when(F.col("a_strand") == "-", F.col("b_start") - F.col("a_end")).otherwise(F.col("a_start") - F.col("b_end"))
    follows = (F.col("a_strand") == F.col("b_strand")) & behind.between(1, run)
    over = (F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end"))
    turned = F.when(meets(im, ir), "s").when(meets(m, r), "x").otherwise(plain)
    code = F.when(over, F.when(opposite, turned).otherwise(plain)).when(follows, "p")
    coded = pairs.select(F.col("a_id").alias("id"), F.col("b_id").alias("ref"), code.alias("code"), exon_overlap(m, r).alias("common")).filter("code is not null")
    best = coded.groupBy("id").agg(F.min(F.struct(code_rank(F.col("code")).alias("rank"), (-F.col("common")).alias("less"), "ref", "code")).alias("b"))
    share = F.coalesce(F.col("repeat_share"), F.lit(0.0)) if "repeat_share" in queries.columns else F.lit(0.0)
    # a repeat comes before no overlap at all, but after a run
    out = queries.select("id", share.alias("share")).join(best, "id", "left")
    return out.select("id", F.coalesce("b.code", F.when(F.col("share") >= repeats, "r").otherwise("u")).alias("code"), F.col("b.ref").alias("ref"))


def best_codes(pairs: DataFrame, key: str, code: str = "code", *order: str) -> DataFrame:
    """Of each key's rows the one whose code ranks first."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(code_rank(F.col(code)), *order))
    return pairs.withColumn("rank_", rank).filter("rank_ = 1").drop("rank_")
