"""Special functions, exact tests, text fields, coordinate maps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import sequence, stats, text

EX = "array<struct<start:bigint,end:bigint>>"


def test_log_gamma_and_poisson(spark):
    df = spark.createDataFrame([(x,) for x in (0.1, 0.5, 1.0, 2.0, 7.3, 30.0, 1e6)], "x double")
    for r in df.select("x", stats.log_gamma(F.col("x")).alias("y"), stats.erfc(F.col("x") - 2).alias("e")).collect():
        assert r["y"] == pytest.approx(math.lgamma(r["x"]), abs=1e-9, rel=1e-9)
        assert r["e"] == pytest.approx(math.erfc(r["x"] - 2), abs=1e-12)
    term = lambda m, i: math.exp(-m) * m**i / math.factorial(i)
    row = spark.range(1).select(stats.poisson_term(F.lit(2.5), F.lit(4)).alias("t"), stats.poisson_cutoff(F.lit(0.8), 1e-6, 100).alias("c"), stats.poisson_cutoff(F.lit(0.8), 0.0, 10).alias("none")).first()
    assert row["t"] == pytest.approx(term(2.5, 4))
    assert row["c"] == next(x for x in range(2, 100) if term(0.8, x) < 1e-6) + 1
    assert row["none"] == 0


def test_incomplete_functions():
    for n in range(1, 6):
        for z in (0.0, 0.3, 2.0, 9.0):
            want = math.exp(-z) * sum(z**k / math.factorial(k) for k in range(n))
            assert stats.upper_gamma(np.array([n]), np.array([z]))[0] == pytest.approx(want, abs=1e-12)
    for a, b in ((1, 1), (2, 5), (6, 3)):
        for x in (0.0, 0.1, 0.5, 0.9, 1.0):
            want = sum(math.comb(a + b - 1, j) * x**j * (1 - x) ** (a + b - 1 - j) for j in range(a, a + b))
            assert stats.incomplete_beta(np.array([a]), np.array([b]), np.array([x]))[0] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("t", [(3, 1, 1, 3), (12, 5, 29, 2), (0, 4, 4, 0), (5, 0, 0, 0), (0, 0, 0, 0)])
def test_fisher(spark, t):
    a, b, c, d = t
    row, col, n = a + b, a + c, sum(t)
    p = {x: math.comb(row, x) * math.comb(n - row, col - x) / math.comb(n, col) for x in range(max(0, row + col - n), min(row, col) + 1)}
    got = spark.createDataFrame([t], "a int, b int, c int, d int").select(stats.fisher_exact(*map(F.col, "abcd")).alias("x")).first()["x"]
    assert got["left"] == pytest.approx(sum(v for x, v in p.items() if x <= a))
    assert got["right"] == pytest.approx(sum(v for x, v in p.items() if x >= a))
    assert got["two"] == pytest.approx(sum(v for v in p.values() if v <= p[a] * (1 + 1e-8)))


def test_text(spark):
    df = spark.createDataFrame([("a%20b%3Bc%25%0a%4", "gene:ENSG1", "2"), ("", "ENSG1.2", "2"), ("100%", "x", None)], "t string, i string, v string")
    got = df.select(text.percent_decode(F.col("t")).alias("t"), text.ensembl_id(F.col("i"), F.col("v")).alias("i")).collect()
    assert [tuple(r) for r in got] == [("a b.cprc%0a%4", "ENSG1.2"), ("", "ENSG1.2"), ("100%", "x")]
    maps = spark.createDataFrame([({"g": "1", "s": "q"}, [{"g": "1", "s": "x", "t": "5", "exon_id": "e"}, {"g": "1", "s": "x", "t": "6", "exon_id": "e"}])], "own map<string,string>, ex array<map<string,string>>")
    assert maps.select(text.reduce_attrs(F.col("own"), F.col("ex")).alias("x")).first()["x"] == {"g": "1", "s": "q", "exon_s": "x"}
    reads = spark.createDataFrame([("r", "ACGN", "IIII"), ("r", "ACG", "II"), ("r", "AXG", "III"), ("r", None, None)], "n string, s string, q string")
    assert [r["x"]["seq"] for r in reads.select(text.sound_read(F.col("n"), F.col("s"), F.col("q")).alias("x")).collect()] == ["ACGN", "N", "N", "N"]


def _trim(s, least):
    score = best = cut = 0
    for i in range(1, len(s)):
        score += 1 if s[-1 - i] == s[-i] else -1
        if score > best:
            best, cut = score, i
    return s[: len(s) - cut] if best >= least else s


def test_trim_homopolymer(spark):
    rows = ["", "A", "ACGT", "ACGTAAAA", "CCAAAATAAAAA", "AAAAAA", "TTTTTG"]
    for least in (1, 3):
        got = spark.createDataFrame([(r,) for r in rows], "s string").select(text.trim_homopolymer(F.col("s"), least).alias("x")).collect()
        assert [r["x"] for r in got] == [_trim(r, least) for r in rows]


def test_coordinates(spark):
    exons = [(11, 20), (31, 35), (41, 41)]
    places = [p for s, e in exons for p in range(s, e + 1)]
    df = spark.createDataFrame([(exons, s, i, p) for s in "+-" for i, p in enumerate([*places, 5, 25, 99])], f"ex {EX}, s string, i long, p long")
    cols = [F.col(c) for c in ("ex", "s", "p")]
    for r in df.select("*", sequence.to_transcript(*cols).alias("t"), sequence.to_genome(cols[0], cols[1], F.col("i") + 1).alias("g"), sequence.exon_of(cols[0], cols[2]).alias("n")).collect():
        order = places if r["s"] == "+" else places[::-1]
        assert r["t"] == (order.index(r["p"]) + 1 if r["p"] in order else None)
        assert r["g"] == (order[r["i"]] if r["i"] < len(order) else None)
        assert r["n"] == next((k for k, (s, e) in enumerate(exons, 1) if s <= r["p"] <= e), 0)
    padded = df.select(sequence.pad_ends(F.col("ex"), 5).alias("x")).first()["x"]
    assert [tuple(e) for e in padded] == [(6, 20), (31, 35), (41, 46)]


def test_quality_kmers(spark):
    df = spark.createDataFrame([("ACGTA", "II!II")], "s string, q string")
    got = df.select(sequence.quality_kmers(F.col("s"), F.col("q"), 2, 20).alias("x")).first()["x"]
    assert [tuple(g) for g in got] == [("AC", 1), ("CG", 0), ("GT", 0), ("TA", 1)]
