"""Joining mates over the overlap graph of unitigs, and paths at ends that only two of them have.

The search for mates runs once for each distinct (first, last) pair of oriented unitigs, however many inserts
share it, and lengthens all open paths by one unitig a round. Rounds are written to the shared
folder; a path holds unitig names only, and its bases are summed on the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import revcomp
from .graph import components
from .stored import stored

MOST_PATHS = 400


def overlaps(unitigs: DataFrame, k: int) -> DataFrame:
    """(unitig, seq) -> step, to, add: oriented unitigs (name with F or R) of which the second begins
    with the last k - 1 bases of the first, and the bases that it adds."""
    name = F.col("unitig").cast("string")
    sound = unitigs.filter(F.length("seq") >= k)
    both = sound.select(F.concat(name,
        F.lit("F")).alias("u"), F.upper("seq").alias("seq")).unionByName(sound.select(F.concat(name, F.lit("R")).alias("u"),
        revcomp(F.upper("seq")).alias("seq")))
    ends = both.select(F.col("u").alias("step"), F.substring("seq", -(k - 1), k - 1).alias("key"))
    starts = both.select(F.col("u").alias("to"), F.substring("seq", 1, k - 1).alias("key"), (F.length("seq") - (k - 1)).cast("long").alias("add"))
    return ends.join(starts, "key").select("step", "to", "add")


def join_mates(inserts: DataFrame, unitigs: DataFrame, k: int, mean: float, stdev: float, reach: float = 5, most: int = MOST_PATHS) -> DataFrame:
    """id, status, path, bases: the one path between an insert's mates whose length is plausible.

    ``inserts``: id, first and last (oriented unitigs as in ``overlaps``), skipped (bases of the first
    before the insert) and rest (bases of the last beyond it). An insert is plausible within ``reach``
    standard deviations of the mean. status: ``joined`` (one path), ``several``, ``none``, or ``many``
    where more than ``most`` paths of a pair are open in a round: its search then ends.
    Rows with a null are ``none``.
    """
    high, low = mean + reach * stdev, mean - reach * stdev
    edges = stored(overlaps(unitigs, k), "overlaps")
    sizes = unitigs.filter(F.length("seq") >= k).select(F.explode(F.array(F.concat("unitig", F.lit("F")),
        F.concat("unitig", F.lit("R")))).alias("first"), F.length("seq").cast("long").alias("bases"))
    pair = ["first", "last"]
    goals = inserts.groupBy(*pair).agg(F.max(F.lit(high) + F.col("skipped") + F.col("rest")).alias("allow"))
    open_ = goals.join(sizes, "first").select(*pair, "allow", F.array("first").alias("path"), F.col("first").alias("at"), "bases").filter("bases <= allow")
    found = many = None
    while True:
        open_ = stored(open_, "open")
        if not open_.limit(1).count():
            break
        crowd = stored(open_.groupBy(*pair).count().filter(F.col("count") > most).select(*pair), "crowd")
        open_ = open_.join(crowd, pair, "left_anti")
        there = open_.filter("at = last").select(*pair, "path", "bases")
        found, many = (there, crowd) if found is None else (found.unionByName(there), many.unionByName(crowd))
        longer = open_.join(edges, open_.at == edges.step)
        open_ = longer.select(*pair, "allow", F.concat("path", F.array("to")).alias("path"), F.col("to").alias("at"),
            (F.col("bases") + F.col("add")).alias("bases")).filter("bases <= allow")
    if found is None:
        return inserts.select("id", F.lit("none").alias("status"), F.lit(None).cast("array<string>").alias("path"), F.lit(None).cast("long").alias("bases"))
    many = many.distinct().withColumn("crowded", F.lit(True))
    found = found.join(many, pair, "left_anti")
    span = F.col("bases") - F.col("skipped") - F.col("rest")
    hits = inserts.join(found, pair).filter(span.between(low, high)).groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("path", "bases")).alias("one"))
    rows = inserts.join(many, pair, "left").join(hits, "id", "left")
    status = F.when(F.col("crowded"), "many").when(F.col("n") == 1, "joined").when(F.col("n") > 1, "several").otherwise("none")
    only = lambda c: F.when((F.col("n") == 1) & F.col("crowded").isNull(), F.col(f"one.{c}"))
    return rows.select("id", status.alias("status"), only("path").alias("path"), only("bases").alias("bases"))


def _unit(c: str):
    return F.regexp_replace(c, "[FR]$", "")


def _walk(rows):
    """One chain of paths as one path: (members with direction, path). A closed chain is cut before its least id."""
    import pandas as pd

    back = lambda path: [u[:-1] + ("R" if u[-1] == "F" else "F") for u in reversed(path)]
    at = {r.id: (list(r.path), r.left, r.right) for r in rows.itertuples()}
    other: dict[str, list] = {}
    for i, (_, a, b) in sorted(at.items()):
        for u in (a, b):
            if u is not None:
                other.setdefault(u, []).append(i)
    begin = min((i for i, (_, a, b) in at.items() if a is None or b is None), default=min(at))
    path, left, right = at[begin]
    turn = left is not None and right is None
    whole, out = back(path) if turn else path, [(begin, "R" if turn else "F")]
    door, last = (left, begin) if turn else (right, begin)
    while door is not None:
        last = next(i for i in other[door] if i != last)
        if last == begin:
            break
        path, left, right = at[last]
        turn = right == door
        step = back(path) if turn else path
        whole, door = whole + step[1:], left if turn else right
        out.append((last, "R" if turn else "F"))
    if (len(whole[0]), whole[0]) > (len(whole[-1]), whole[-1]):
        whole, out = back(whole), [(i, "F" if d == "R" else "R") for i, d in reversed(out)]
    return pd.DataFrame({"members": [[{"id": i, "direction": d} for i, d in out]], "path": [whole]})


def merge_uniquely(paths: DataFrame) -> DataFrame:
    """(id, path): distinct paths of two unitigs or more -> members (id, direction) and path of each chain.

    Two paths meet at a unitig that ends just those two, one on each of its sides, and is inside no path
    nor a path of its own. Chains of one path, those of one unitig among them, stay as they are. A closed
    chain is cut before its least id. The shorter name, then the lesser, is the first end of a merged path.
    Rows without id or units are left out; a chain is one row of the result and so is walked in one task.
    """
    rows = paths.filter("id is not null and size(path) > 0").select(F.col("id").cast("long").alias("id"), "path")
    n = F.size("path")
    inner = rows.select(F.explode(F.when(n > 2, F.slice("path", 2, F.greatest(n - 2, F.lit(0)))).when(n == 1,
        F.col("path")).otherwise(F.slice("path", 1, 0))).alias("u")).select(_unit("u").alias("unit")).distinct()
    end = lambda at, side: F.struct(F.lit(side).alias("side"), F.element_at("path", at).alias("u"))
    ends = rows.filter(n > 1).select("id", F.explode(F.array(end(1, "left"), end(-1, "right"))).alias("e")).select("id", "e.side",
        _unit("e.u").alias("unit"), (F.col("e.u").endswith("F") == (F.col("e.side") == "right")).alias("before"))
    doors = ends.groupBy("unit").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"),
        F.count_if("before").alias("k")).filter("n = 2 and k = 1 and a <> b").join(inner, "unit", "left_anti")
    doors = stored(doors.select("unit", "a", "b"), "doors")
    chain = components(doors.select("a", "b")).select(F.col("node").alias("id"), "component")
    linked = ends.join(doors.select("unit"), "unit",
        "left_semi").groupBy("id").agg(F.max(F.when(F.col("side") == "left", F.col("unit"))).alias("left"),
        F.max(F.when(F.col("side") == "right", F.col("unit"))).alias("right"))
    kind = "members array<struct<id:bigint,direction:string>>, path array<string>"
    merged = rows.join(linked, "id").join(chain, "id").groupBy("component").applyInPandas(_walk, kind)
    alone = rows.join(chain, "id", "left_anti").select(F.array(F.struct("id", F.lit("F").alias("direction"))).alias("members"), "path")
    return merged.unionByName(alone)
