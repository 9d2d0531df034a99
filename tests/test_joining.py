"""Joining mates over unitigs against a search that lists all paths."""

import itertools
import random
from collections import Counter

from strandline.operators import joining

K = 5
INSERTS = "id long, first string, last string, skipped long, rest long"


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_join_mates_equals_brute_force(spark):
    rng = random.Random(3)
    keys = ["ACCA", "GATC", "TTGC", "CAGT"]
    seqs = {i: rng.choice(keys) + "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 6))) + rng.choice(keys) for i in range(14)}
    names = {f"{i}{d}": s if d == "F" else turned(s) for i, s in seqs.items() for d in "FR"}
    rows = [(n, rng.choice([*names]), rng.choice([*names]), rng.randint(0, 3), rng.randint(0, 3)) for n in range(60)] + [(90, "77F", "0F", 0, 0), (91, None, "0F", 0, 0), (92, "0F", "0F", None, 0)]
    mean, stdev, reach, most = 22, 3, 2, 60

    def search(first, last, allow):
        level, out = [([first], len(names[first]))] if first in names and len(names[first]) <= allow else [], []
        while level:
            if len(level) > most:
                return None
            out += [(p, n) for p, n in level if p[-1] == last]
            level = [([*p, v], n + len(s) - K + 1) for p, n in level for v, s in names.items() if names[p[-1]][-K + 1 :] == s[: K - 1] and n + len(s) - K + 1 <= allow]
        return out

    allow = {}
    for _, a, b, x, y in rows:
        if x is not None:
            allow[a, b] = max(allow.get((a, b), 0), mean + reach * stdev + x + y)
    want = {}
    for n, a, b, x, y in rows:
        paths = search(a, b, allow[a, b]) if a is not None and (a, b) in allow else []
        fit = [p for p in paths or [] if x is not None and mean - reach * stdev <= p[1] - x - y <= mean + reach * stdev]
        want[n] = ("many", None, None) if paths is None else ("joined", *fit[0]) if len(fit) == 1 else ("several" if fit else "none", None, None)
    unitigs = spark.createDataFrame([*seqs.items()], "unitig long, seq string")
    got = joining.join_mates(spark.createDataFrame(rows, INSERTS), unitigs, K, mean, stdev, reach, most).collect()
    assert {r["id"]: (r["status"], r["path"], r["bases"]) for r in got} == want
    assert len(got) == len(rows)
    assert {"joined", "several", "none", "many"} >= {r["status"] for r in got} >= {"joined", "none"}


def test_join_mates_without_rows(spark):
    unitigs = spark.createDataFrame([(1, "ACCAGATC")], "unitig long, seq string")
    assert joining.join_mates(spark.createDataFrame([], INSERTS), unitigs, K, 20, 2).count() == 0
    one = joining.join_mates(spark.createDataFrame([(1, "1F", "1F", 0, 0)], INSERTS), unitigs.limit(0), K, 20, 2).first()
    assert (one["status"], one["path"]) == ("none", None)


def back(path):
    return [u[:-1] + "FR"[u[-1] == "F"] for u in reversed(path)]


def merged_plainly(paths):
    """Two paths at a time, until none meet; members as a set, the path in either direction."""
    inside = {u[:-1] for p in paths.values() for u in (p if len(p) == 1 else p[1:-1])}
    ends = Counter(u[:-1] for p in paths.values() if len(p) > 1 for u in (p[0], p[-1]))
    sides = {u: {(p[i][-1] == "F") == (i == -1) for p in paths.values() if len(p) > 1 for i in (0, -1) if p[i][:-1] == u} for u in ends}
    one = {u for u in ends if any(len(p) > 1 and p[0][:-1] == p[-1][:-1] == u for p in paths.values())}
    doors = {u for u, n in ends.items() if n == 2 and u not in inside | one and len(sides[u]) == 2}
    rows, moved = [({i}, p) for i, p in paths.items()], True
    while moved:
        moved = False
        for x, y in itertools.permutations(rows, 2):
            for a, b in itertools.product((x[1], back(x[1])), (y[1], back(y[1]))):
                if not moved and len(a) > 1 and len(b) > 1 and a[-1] == b[0] and a[-1][:-1] in doors:
                    rows = [r for r in rows if r is not x and r is not y] + [(x[0] | y[0], a + b[1:])]
                    moved = True
            if moved:
                break
    return rows


def test_merge_uniquely_equals_plain_merging(spark):
    rng = random.Random(11)
    for trial in range(4):
        units = rng.sample(range(100, 400), 60)
        paths, k = {}, 0
        for chain in range(12):  # lines cut into pieces, some turned over, some ends shared by others
            line = [f"{units[k + j]}{rng.choice('FR')}" for j in range(5)]
            k += 5
            for a, b in ((0, 2), (2, 3), (3, 4)):
                piece = line[a : b + 1]
                paths[len(paths)] = back(piece) if rng.random() < 0.5 else piece
            if chain % 4 == trial % 4:
                paths[len(paths)] = [rng.choice((line[2], line[3])), f"{900 + chain}F"]
        paths[len(paths)] = [f"{units[4]}F"]
        got = joining.merge_uniquely(spark.createDataFrame([*paths.items()], "id long, path array<string>")).collect()
        want = merged_plainly(paths)
        one = lambda p: min(tuple(p), tuple(back(p)))
        assert sorted((sorted(m["id"] for m in r["members"]), one(r["path"])) for r in got) == sorted((sorted(i), one(p)) for i, p in want)
        for r in got:
            whole = []
            for m in r["members"]:
                p = paths[m["id"]] if m["direction"] == "F" else back(paths[m["id"]])
                whole += p if not whole else p[1:]
            assert whole == r["path"]


def test_merge_uniquely_rings_and_empty_tables(spark):
    ring = {1: ["1F", "2F", "3F"], 2: ["3F", "4F", "5F"], 3: ["5F", "6F", "1F"], 4: None, 5: []}
    got = joining.merge_uniquely(spark.createDataFrame([*ring.items()], "id long, path array<string>")).collect()
    assert len(got) == 1 and sorted(m["id"] for m in got[0]["members"]) == [1, 2, 3] and len(got[0]["path"]) == 7
    assert joining.merge_uniquely(spark.createDataFrame([], "id long, path array<string>")).count() == 0
