"""Components, paths, unitigs and read correction against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import graph, unitigs
from strandline.operators.kmers import count_kmers

PAIR = dict(zip("ACGT", "TGCA", strict=True))


def rc(s):
    return "".join(PAIR[c] for c in reversed(s))


def canon(s):
    return min(s, rc(s))


def plain_unitigs(mers, k):
    nodes = {m for x in mers for m in (x, rc(x))}
    after = lambda x: [x[1:] + c for c in "ACGT" if x[1:] + c in nodes]
    before = lambda x: [c + x[:-1] for c in "ACGT" if c + x[:-1] in nodes]

    def step(x):
        y = after(x)
        ok = len(y) == 1 and len(before(y[0])) == 1 and y[0] not in (x, rc(x)) and rc(x) != x and rc(y[0]) != y[0]
        return y[0] if ok else None

    nxt = {x: step(x) for x in nodes}
    heads, out, seen = nodes - set(nxt.values()), set(), set()
    for h in heads:
        x, s = h, h
        seen.add(x)
        while nxt[x]:
            x = nxt[x]
            seen.add(x)
            s += x[-1]
        out.add(min(s, rc(s)))
    cycles = set()
    for x in nodes - seen:
        path, y = [x], nxt[x]
        while y != x:
            path.append(y)
            y = nxt[y]
        cycles.add((min(map(canon, path)), len(path)))
    return out, cycles


@pytest.mark.parametrize("seed", range(3))
def test_unitigs(spark, seed):
    rng = random.Random(seed)
    k, base = 7, lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    ring = base(40)
    a = base(120)
    reads = [a, a[30:60] + base(40), rc(a[50:100]), ring + ring[: k - 1], "ACGTACG", "A" * 9]
    counts = count_kmers(spark.createDataFrame([(r,) for r in reads], ["seq"]), k)
    mers = [r["mer"] for r in counts.collect()]
    lines, cycles = plain_unitigs(mers, k)
    got = unitigs.build(counts, k).collect()
    assert len({r["seq"] for r in got}) == len(got)
    assert {r["seq"] for r in got} >= {s for s in lines}
    assert sorted((min(canon(s[i : i + k]) for i in range(len(s) - k + 1)), r["kmers"]) for r in got if (s := r["seq"]) not in lines) == sorted(cycles)
    assert sorted(canon(r["seq"][i : i + k]) for r in got for i in range(r["kmers"])) == sorted(mers)


def test_read_matches(spark):
    rng = random.Random(5)
    u = "".join(rng.choice("ACGT") for _ in range(60))
    reads = spark.createDataFrame([(1, u[5:30]), (2, rc(u[10:40])), (3, u[0:12] + "T" + u[13:40])], "id long, seq string")
    got = {tuple(r) for r in unitigs.read_matches(reads, spark.createDataFrame([(9, u)], "unitig long, seq string"), 11).select("id", "direction", "read_at", "unitig_at", "kmers").collect()}
    assert (1, "F", 0, 5, 15) in got
    assert (2, "R", 0, 10, 20) in got
    if u[12] != "T":
        assert {(3, "F", 0, 0, 2), (3, "F", 13, 13, 17)} <= got


def test_unitigs_with_low_counts(spark):
    rng = random.Random(5)
    genome = "".join(rng.choice("ACGT") for _ in range(80))
    side = genome[:30] + PAIR[genome[30]] + genome[31:50]
    seen = lambda *reads: count_kmers(spark.createDataFrame([(r,) for r in reads], ["seq"]), 13)
    built = lambda counts, **how: {r["seq"]: r["kmers"] for r in unitigs.build(counts, 13, **how).collect()}
    # a branch seen once beside a path seen three times is none, and is no unitig of its own
    assert built(seen(*[genome] * 3, side), threshold=2, low_run=3) == {canon(genome): 68}
    assert len(built(seen(*[genome] * 3, side))) > 2
    # between two parts seen often there are two k-mers seen once: one in a row more than may be passed, or not
    parts = seen(*[genome[:40]] * 3, *[genome[30:]] * 3, genome)
    assert built(parts, threshold=2, low_run=2) == {canon(genome): 68}
    assert built(parts, threshold=2, low_run=1) == {canon(genome[:40]): 28, canon(genome[30:]): 38}
    assert built(parts, least=2) == built(parts, threshold=2)


def test_correct_reads(spark):
    rng = random.Random(8)
    genome = "".join(rng.choice("ACGT") for _ in range(300))
    clean = [genome[i : i + 60] for i in range(0, 240, 3)]
    swap = lambda s, p: s[:p] + PAIR[s[p]] + s[p + 1 :]
    src = genome[100:160]
    cases = {1: (src, src), 2: (swap(src, 30), src), 3: (swap(src, 3), src), 4: (swap(swap(src, 20), 50), src), 5: (rc(swap(src, 40)), rc(src))}
    reads = spark.createDataFrame([(i, c[0]) for i, c in cases.items()] + [(6, "ACGT" * 10), (7, src[:40] + "".join(PAIR[c] for c in src[40:])), (8, ""), (9, None)], "id long, seq string")
    counts = count_kmers(spark.createDataFrame([(c,) for c in clean], ["seq"]), 13)
    got = {r["id"]: r for r in unitigs.correct_reads(reads, counts, 13, 2, rounds=2).collect()}
    for i, (raw, want) in cases.items():
        assert got[i]["seq"] == want
        assert got[i]["changes"] == sum(x != y for x, y in zip(raw, want, strict=True))
        assert got[i]["cut"] == 0
    assert not {6, 8, 9} & set(got)
    assert got[7]["seq"].startswith(src[:40])
    assert got[7]["cut"] + len(got[7]["seq"]) == 60


def test_correct_reads_with_many_errors(spark):
    rng = random.Random(9)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    raw = "".join(PAIR[c] if i in (40, 80, 120, 160, 200, 240, 280) else c for i, c in enumerate(genome))
    counts = count_kmers(spark.createDataFrame([(genome,)] * 2, ["seq"]), 13)
    reads = spark.createDataFrame([(1, raw), (2, rc(raw)), (3, genome)], "id long, seq string")
    got = {tuple(r) for r in unitigs.correct_reads(reads, counts, 13, 2).collect()}
    assert got == {(1, genome, 7, 0), (2, rc(genome), 7, 0), (3, genome, 0, 0)}


def test_components_and_gene_clusters(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (30, 30), (None, 4)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 7, 8, 9), 1), 20: 20, 21: 20, 30: 30}
    exons = [("g1", "c", "+", 1, 10), ("g1", "c", "+", 50, 60), ("g2", "c", "+", 60, 70), ("g3", "c", "+", 70, 80), ("g4", "c", "-", 1, 99), ("g5", "c", "+", 11, 12), ("g6", "d", "+", 1, 10)]
    df = spark.createDataFrame(exons, "gene string, contig string, strand string, start long, end long")
    assert {r["gene"]: r["cluster"] for r in graph.gene_clusters(df).collect()} == {"g1": "g1", "g2": "g1", "g3": "g1", "g4": "g4", "g5": "g5", "g6": "g6"}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_paths_both_ways(spark):
    paths = spark.createDataFrame([("a", ["1F", "2R", "3F"]), ("b", ["2F", "1R"]), ("c", ["2R", "3F"]), ("d", ["3F", "2R"]), ("e", [])], "id string, path array<string>")
    assert {tuple(r) for r in graph.reduced(paths, both=True).collect()} == {("b", "a", "R", 0), ("c", "a", "F", 1)}
    units = spark.createDataFrame([("1", "AACC"), ("2", "TTGG"), ("3", "AAGT")], "unitig string, seq string")
    got = {r["id"]: r["seq"] for r in graph.path_sequences(paths.filter("id in ('a', 'b')"), units, 3).collect()}
    assert got["a"] == "AACC" + "AA" + "GT"
    assert got["b"] == rc("AACC" + "AA")
    placements = spark.createDataFrame([(1, "x", 5, "F"), (2, "x", 5, "R"), (3, "y", 1, "F"), (4, "z", 1, "F"), (5, "w", 7, "F")], "read long, super string, offset long, direction string")
    cuts = spark.createDataFrame([("x", "y", "R", 100), ("z", "y", "F", 10)], "super string, container string, direction string, shift long")
    good = spark.createDataFrame([("y",)], ["super"])
    assert {tuple(r) for r in graph.moved_placements(placements, cuts, good).select("read", "super", "offset", "direction").collect()} == {(1, "y", 95, "R"), (2, "y", 95, "F"), (3, "y", 1, "F"), (4, "y", 11, "F")}


def test_em_stops(spark):
    reads = spark.createDataFrame([(1, "a", 100), (1, "b", 100), (2, "a", 100)], "read long, target string, len long")
    targets = spark.createDataFrame([("a", 1000), ("b", 1000), ("c", 10)], "target string, size long")
    got = {r["target"]: r["cov"] for r in graph.em_coverage(reads, targets, 50, until=1e-6).collect()}
    assert got["c"] == 0
    assert got["a"] + got["b"] == pytest.approx(0.2)
    share = (1 + got["a"]) / (2 + got["a"] + got["b"])
    assert got["a"] == pytest.approx(0.1 + 0.1 * share, abs=1e-5)
