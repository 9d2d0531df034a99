"""The filter language, class codes and nascents, streams."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions.filterlang import compile_filter
from strandline.operators import classes, graph, intervals, records, transcripts
from strandline.streaming.bundles import stream_bundles, stream_lookup

EX = "array<struct<start:bigint,end:bigint>>"


@pytest.mark.parametrize(
    ("text", "holds"),
    [
        ("flag.paired && mapq>=30", True),
        ("flag.paired && mapq>=30 || [NM]<2", True),
        ("[ZZ]==1", False),
        ("!exists([ZZ])", True),
        ("![ZZ]", True),
        ('rname=~"^chr"', True),
        ('rname!~"^chr"', False),
        ("rname==5", False),
        ("rname!=5", True),
        ("[ZZ] && 0", False),
        ("1 || [ZZ]", True),
        ("length(rname)==4", True),
        ("mapq % 7 == 4 && (mapq & 32) == 32", True),
        ("0 && 0 || 1", True),
        ("1 || 0 && 0", False),
        ("default([ZZ], 7) == 7", True),
        ("sqrt(-1) == 0", False),
        ('!""', False),
    ],
)
def test_filter(spark, text, holds):
    df = spark.createDataFrame([(65, 60, "chr1", 1)], "flag int, mapq int, rname string, nm int")
    got = df.select(compile_filter(text, {k: F.col(k) for k in ("flag", "mapq", "rname")}, {"rname"}, {"NM": F.col("nm")}).alias("x")).first()["x"]
    assert got is holds


@pytest.mark.parametrize("text", ["mapq >", "what", "(mapq", "mapq mapq", "f(1)"])
def test_filter_errors(spark, text):
    with pytest.raises(ValueError, match="filter"):
        compile_filter(text, {"mapq": F.lit(1)})


CODES = [
    ([(1, 10), (20, 30)], [(1, 10), (20, 30)], "="),
    ([(2, 10), (20, 33)], [(1, 10), (20, 30)], "~"),
    ([(5, 10), (20, 25)], [(1, 10), (20, 30), (40, 50)], "c"),
    ([(1, 10), (20, 30), (40, 50)], [(5, 10), (20, 25)], "k"),
    ([(1, 30)], [(5, 10), (20, 25)], "m"),
    ([(1, 30)], [(5, 10), (20, 28), (40, 50)], "n"),
    ([(1, 10), (22, 30)], [(1, 10), (20, 30)], "j"),
    ([(5, 15)], [(1, 10), (20, 30)], "o"),
    ([(1, 35)], [(1, 20), (50, 60)], "e"),
    ([(12, 18)], [(1, 10), (20, 30)], "i"),
    ([(1, 10), (20, 30)], [(12, 18)], "y"),
    ([(5, 40)], [(1, 30)], "~"),
    ([(25, 60)], [(1, 30)], "o"),
    ([(5, 20)], [(1, 30)], "c"),
    ([(25, 60)], [(30, 40)], "k"),
    ([(1, 30)], [(1, 30)], "="),
    ([(1, 30)], [(2, 33)], "~"),
    ([(5, 10), (20, 30)], [(1, 10), (20, 30), (40, 50), (60, 70)], "c"),
    ([(5, 10), (20, 33)], [(1, 10), (20, 30), (40, 50)], "c"),
    ([(5, 10), (20, 35)], [(1, 10), (20, 30), (40, 50)], "j"),
    ([(5, 10), (20, 45)], [(1, 10), (20, 30), (40, 50)], "m"),
    ([(5, 10), (22, 45)], [(1, 10), (20, 30), (40, 50)], "n"),
    ([(1, 10), (20, 30)], [(8, 10), (20, 90)], "~"),
    ([(12, 14), (16, 18)], [(1, 10), (20, 30)], "i"),
    ([(1, 9), (30, 40)], [(12, 14), (16, 18)], "y"),
    ([(1, 3)], [(10, 30)], "."),
]


def test_class_codes(spark):
    df = spark.createDataFrame([(i, m, r) for i, (m, r, _) in enumerate(CODES)], f"i int, m {EX}, r {EX}")
    got = {r["i"]: r["x"] for r in df.select("i", classes.class_code(F.col("m"), F.col("r")).alias("x")).collect()}
    assert [(m, r, got[i]) for i, (m, r, _) in enumerate(CODES)] == CODES


def test_class_codes_without_single_ends(spark):
    df = spark.createDataFrame([([(1, 30)], [(1, 30)]), ([(5, 40)], [(1, 30)]), ([(1, 10), (20, 30)], [(1, 10), (20, 30)])], f"m {EX}, r {EX}")
    assert [r["x"] for r in df.select(classes.class_code(F.col("m"), F.col("r"), single_ends=False).alias("x")).collect()] == ["k", "k", "="]
    ranks = spark.createDataFrame([("=",), ("u",), ("?",), (None,)], "c string").select(classes.code_rank(F.col("c")).alias("x"), classes.coding_code(F.col("c"), F.lit(False)).alias("y")).collect()
    assert [tuple(r) for r in ranks] == [(0, ":"), (94, "u"), (96, "?"), (100, None)]


def test_nascents(spark):
    tx = spark.createDataFrame([(s, [(1, 10), (20, 30), (40, 50)], 1, 50) for s in "+-"], f"strand string, exons {EX}, start long, end long")
    got = {(r["strand"], r["step"]): [tuple(e) for e in r["exons"]] for r in transcripts.nascents(tx).collect()}
    assert got == {("+", 1): [(1, 19)], ("+", 2): [(1, 10), (20, 39)], ("-", 1): [(31, 50)], ("-", 2): [(11, 30), (40, 50)]}


def test_bundles_and_bins(spark):
    df = spark.createDataFrame([("c", 1, 1000), ("c", 1200, 1250), ("c", 1451, 1460)], "contig string, start long, end long")
    assert [r["cluster"] for r in intervals.clusters(df, 200).orderBy("start").collect()] == [1, 1, 2]
    rows = [(i, "c", i * 37 % 500, i * 37 % 500 + i % 90) for i in range(120)]
    a = spark.createDataFrame(rows, "id long, contig string, start long, end long")
    naive = {(x[0], y[0]) for x in rows for y in rows if x[2] <= y[3] and y[2] <= x[3]}
    for size in (16, 64, 8192):
        got = [(r["a_id"], r["b_id"]) for r in intervals.overlap_join(a, a, size).collect()]
        assert len(got) == len(set(got))
        assert set(got) == naive


def test_paths(spark):
    paths = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b", "c"]), (3, ["c", "b"])], "id long, path array<string>")
    assert {(r["read"], r["container"]) for r in graph.reduced(paths).collect()} == {(2, 1)}


def test_head(spark):
    df = spark.range(10)
    assert [r["id"] for r in records.head(df, -7, "id").orderBy("id").collect()] == [0, 1, 2]
    assert sorted(r["id"] for r in records.tail(df, 2, "id").collect()) == [8, 9]


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "src"), "bundle_rows"
    rows = [("c", 0), ("c", 150), ("c", 351), ("d", 0)]
    spark.createDataFrame(rows, "contig string, at long").select("contig", F.timestamp_seconds("at").alias("ts")).write.parquet(src)
    stream = spark.readStream.schema("contig string, ts timestamp").parquet(src)
    q = stream_bundles(stream, 200).writeStream.format("memory").queryName(out).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert sorted(r["n"] for r in spark.table(out).collect()) == [1, 1, 2]
    counts = spark.createDataFrame([("CAA", 3)], "mer string, count long")
    reads = spark.createDataFrame([("TTGC",)], ["seq"])
    assert sorted(r["count"] for r in stream_lookup(reads, counts, 3).collect()) == [0, 3]


@pytest.mark.parametrize("block", [None, 7, 64, 1 << 16])
def test_blocks_do_not_change_sweeps(spark, block):
    rows = [("c" if i % 3 else "d", i * 53 % 400, i * 53 % 400 + (i * i) % 41) for i in range(60)] + [("c", 5, 5), ("c", 5, 5)]
    df = spark.createDataFrame(rows, "contig string, start long, end long")
    labels, unions, depth = {}, {}, {}
    for contig in "cd":
        reach, k = None, 0
        for _, s, e in sorted(r for r in rows if r[0] == contig):
            k += reach is None or s > reach + 3
            reach = e if reach is None else max(reach, e)
            labels.setdefault((contig, s, e), []).append(k)
            lo, hi, n = unions.get((contig, k), (s, e, 0))
            unions[contig, k] = (min(lo, s), max(hi, e), n + 1)
            for p in range(s, e + 1):
                depth[contig, p] = depth.get((contig, p), 0) + 1
    got = intervals.clusters(df, 3, block=block).collect()
    assert len(got) == len(rows)
    assert all(r["cluster"] in labels[r["contig"], r["start"], r["end"]] for r in got)
    got = intervals.merged(df.withColumn("w", F.lit(2)), 3, sums=("w",), block=block).collect()
    assert sorted((r["contig"], r["start"], r["end"], r["n"], r["w"]) for r in got) == sorted((c, *u, 2 * u[2]) for (c, _), u in unions.items())
    runs = intervals.coverage(df, block=block).collect()
    assert {(r["contig"], p): r["depth"] for r in runs for p in range(r["start"], r["end"] + 1)} == depth


def test_clusters_of_unsound_rows(spark):
    df = spark.createDataFrame([(None, 1, 2), ("c", None, 5), ("c", 3, None), ("c", 1, 2)], "contig string, start long, end long")
    assert sorted((r["contig"] or "", r["start"] or 0, r["cluster"]) for r in intervals.clusters(df, 0).collect() if r["cluster"]) == [("c", 1, 1)]
    assert intervals.clusters(df, 0).count() == 4


def test_distinct_nascents_equal_brute_force(spark):
    rng, rows = random.Random(5), []
    for i in range(120):
        at, exons = rng.choice((100, 105, 180, 5000)), []
        for _ in range(rng.randint(1, 4)):
            exons.append((at, at + rng.choice((400, 402, 480))))
            at = exons[-1][1] + rng.choice((300, 301))
        rows.append((i, rng.choice("ab"), rng.choice("+-."), exons))
    tx = spark.createDataFrame(rows, f"id long, contig string, strand string, exons {transcripts.EXONS}")

    def match(a, b):
        if len(a) != len(b):
            return False
        if len(a) == 1:
            (s, e), (u, v) = a[0], b[0]
            return (min(e, v) - max(s, u) + 1) / max(e - s + 1, v - u + 1) >= 0.99
        inner = lambda x: [(p[1], q[0]) for p, q in zip(x, x[1:])]
        return inner(a) == inner(b) and abs(a[0][0] - b[0][0]) <= 70 and abs(a[-1][1] - b[-1][1]) <= 70

    kept = []
    for i, contig, strand, x in rows:
        n = len(x)
        for step in range(1, n):
            new = [(x[n - 1 - step][1] + 1, x[n - step][1]), *x[n - step + 1 :]] if strand == "-" else [*x[: step - 1], (x[step - 1][0], x[step][0] - 1)]
            if not any(c == contig and match(new, y) for _, _, c, y in kept):
                kept.append((i, step, contig, new))
    got = transcripts.distinct_nascents(tx, "id").collect()
    assert sorted((r["id"], r["step"], r["contig"], [tuple(e) for e in r["exons"]]) for r in got) == sorted(kept)
    assert transcripts.distinct_nascents(tx.limit(0), "id").count() == 0
