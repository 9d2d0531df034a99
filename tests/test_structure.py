"""Guides, bundles, sizes, headers, manifests and corrections on small cases with known results."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions.intervals import exon_overlap, expand, set_cds
from strandline.functions.filterlang import compile_filter
from strandline.operators import guides, hierarchy, intervals, kmers, records, transcripts, unitigs, variants
from strandline.sources import readers

EX = "array<struct<start:bigint,end:bigint>>"
SPAN = "contig string, start long, end long"


def test_guides_are_pulled_in_over_any_number_of_steps(spark):
    reads = spark.createDataFrame([("a", 1000, 1100), ("a", 1300, 1400), ("a", 2000, 2100), ("a", 2302, 2400), ("b", 5, 9)], SPAN)
    own = spark.createDataFrame([(1, "a", 900, 950), (2, "a", 940, 1010), (3, "a", 1390, 1500), (4, "a", 1700, 1750), (5, "a", 1490, 1510), (6, "a", 2101, 2110), (7, "c", 1, 9)], f"id long, {SPAN}")
    got = guides.bundles(reads, own, block=64)
    # the read at 2302 lies 202 past the end of the bundle: the guide beside that end overlaps no read
    assert sorted(map(tuple, got.select("contig", "bundle", "start", "end", "n_reads").collect())) == [("a", 1, 900, 1510, 2), ("a", 2, 2000, 2100, 1), ("a", 3, 2302, 2400, 1), ("b", 1, 5, 9, 1)]
    assert {r["id"]: r["bundle"] for r in guides.pulled_in(got, own).collect()} == {1: 1, 2: 1, 3: 1, 4: None, 5: 1, 6: None, 7: None}


def test_clusters_in_blocks_equal_one_window(spark):
    rng = random.Random(4)
    rows = [("ab"[rng.randrange(2)], s, s + rng.choice((0, 3, 40, 500))) for s in (rng.randrange(20000) for _ in range(600))] + [(None, 1, 2), ("a", None, 2), ("a", 9, 3)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id long, {SPAN}")
    for gap in (0, 1, 25):
        whole = {r["id"]: r["cluster"] for r in intervals.clusters(df.filter("contig is not null and start <= end"), gap, block=None).collect()}
        cut = {r["id"]: r["cluster"] for r in intervals.clusters(df, gap, block=128).collect()}
        assert {k: v for k, v in cut.items() if v is not None} == whole
        assert len(cut) == len(rows)
        one, many = (sorted(map(tuple, intervals.merged(df, gap, block=b).filter("contig is not null").collect())) for b in (None, 128))
        assert one == many


def test_overlaps_of_several_bin_sizes(spark):
    rng = random.Random(6)
    some = lambda: [(i, "ab"[rng.randrange(2)], s, s + rng.choice((0, 5, 300, 40000, 900000))) for i, s in enumerate(rng.randrange(1000000) for _ in range(120))]
    rows, others = some(), [*some(), (900, "a", None, 5), (901, "a", 9, 3), (902, None, 1, 9)]
    a, b = (spark.createDataFrame(r, f"id long, {SPAN}") for r in (rows, others))
    sound = [(i, c, s, e) for i, c, s, e in others if c and s is not None and s <= e]
    want = sorted((i, j) for i, c, s, e in rows for j, d, t, f in sound if c == d and s <= f and t <= e)
    for sizes in ((64, 512, 1 << 13), (1 << 10, 1 << 16), None):
        assert sorted((r["a_id"], r["b_id"]) for r in intervals.overlap_join(a, b, sizes=sizes).collect()) == want


def test_order_is_checked(spark):
    rows = [(1, "a", 5), (2, "a", 5), (3, "b", 1), (4, "b", 9)]
    make = lambda rows: guides.checked_order(spark.createDataFrame(rows, "line long, contig string, start long"), "line")
    assert make(rows).count() == 4
    for bad, what in (([*rows, (5, "b", 8)], "not in order"), ([*rows, (5, "a", 10)], "comes back")):
        with pytest.raises(Exception, match=what):
            make(bad).collect()


def test_exons_that_count(spark):
    reads = spark.createDataFrame([(1, "c", 10, 20, ".", 0), (2, "c", 10, 12, "+", None), (3, "c", 17, 30, "+", 200), (4, "c", 10, 20, "-", 0)], f"id long, {SPAN}, strand string, mate long")
    own = spark.createDataFrame([(1, "c", 16, 40, "+", 1), (2, "c", 1, 11, "+", 0), (3, "c", 18, 19, "+", 0), (4, "c", 29, 400, "+", 0)], f"id long, {SPAN}, strand string, real int")
    pairs = guides.exon_overlaps(reads, own)
    assert {(r["a_id"], r["b_id"], r["mate_ovl"]) for r in pairs.collect()} == {(1, 1, 0), (3, 1, 0), (3, 4, 1)}
    assert {(r["a_id"], r["b_id"]) for r in guides.best_exons(pairs, "a_id").collect()} == {(1, 1), (3, 1)}
    assert [tuple(r) for r in guides.guide_strand(guides.best_exons(pairs, "a_id"), "a_id").collect()] == [(1, "+")]
    assert {r["id"] for r in guides.without_contigs(reads.withColumn("contig", F.concat("contig", "id")), "c1,c3 c9").collect()} == {2, 4}


def test_coding_spans_and_shared_bases(spark):
    df = spark.createDataFrame([([(1, 10), (20, 30)], [(5, 22), (25, 40)])], f"a {EX}, b {EX}")
    a = F.col("a")
    got = df.select(exon_overlap(a, F.col("b")).alias("n"), set_cds(a, F.lit(5), F.lit(22)).alias("c"), set_cds(a, F.lit(0), F.lit(9)).alias("none"), expand(F.lit(4), F.lit(9), 5, F.lit(2), F.lit(30)).alias("wide")).first()
    assert got["n"] == 6 + 3 + 6
    assert [tuple(p) for p in got["c"]["parts"]] == [(5, 10), (20, 22)]
    assert got["none"] is None
    assert tuple(got["wide"]) == (1, 30)


def test_sizes_of_a_known_set(spark):
    # fixed values: lengths of a public test set, whose statistics are known
    sizes = [359, 106, 217, 73, 76, 215, 132, 240, 227, 0, 141, 144, 428, 516, 443, 106, 172, 253, 469, 122, 28, 296, 164, 0, 68, 297, 105, 112, 589, 421, 36, 48, 81, 0, 231, 165, 6, 139, 237, 314, 376, 458, 40, 45, 133, 0, 15, 116, 358, 0]
    df = spark.createDataFrame([(n,) for n in sizes], "size long")
    for block in (1, 64, 4096):
        got = kmers.nx(df, block=block).first()
        assert (got["n10"], got["n25"], got["n50"], got["n90"], got["total"], got["records"]) == (516, 443, 314, 112, 9317, 50)
        assert (round(got["average"], 2), round(got["e_size"], 3)) == (186.34, 314.704)
    assert kmers.nx(df, (50,), genome=10**6).first()["n50"] is None
    assert tuple(kmers.length_stats(df).first()) == (50, 589, 9317)
    assert tuple(kmers.length_stats(df.limit(0)).first()) == (0, 0, 0)


def test_manifests_lists_and_headers(spark, tmp_path):
    for name in ("s1/a.gtf", "s2/b.gtf", "other/c.gtf", "s3/d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x\n")
    assert [(n, p.rsplit("/", 1)[1]) for n, p in readers.sample_paths(spark, str(tmp_path), "^s")] == [("s1", "a.gtf"), ("s2", "b.gtf")]
    (tmp_path / "list.txt").write_text("# head\nx a.gtf\ny b.gtf\n\n")
    assert readers.sample_paths(spark, f"{tmp_path}/list.txt") == [("x", "a.gtf"), ("y", "b.gtf")]
    for text, what in (("x\n", "a path"), ("x a\nx b\n", "twice"), ("# no\n", "no files")):
        (tmp_path / "bad.txt").write_text(text)
        with pytest.raises(ValueError, match=what):
            readers.sample_paths(spark, f"{tmp_path}/bad.txt")
    (tmp_path / "paths.txt").write_text("#c\n a.gtf \n\nx\nb.gtf\n")
    assert readers.listed_paths(spark, f"{tmp_path}/paths.txt") == ["a.gtf", "b.gtf"]
    lines = spark.createDataFrame([("@HD\tVN:1",), ("@SQ\tSN:c:1\tLN:10\tUR:file:/x",), ("@SQ\tLN:2\tSN:d",), ("r\t0",)], "value string")
    assert [(r["contig"], r["length"], r["tags"]) for r in readers.header_sequences(lines).collect()] == [("c:1", 10, {"UR": "file:/x"}), ("d", 2, {})]
    rows = spark.createDataFrame([("b", 5, 6), ("a", 1, 2)], SPAN)
    order = spark.createDataFrame([("b", 0), ("a", 1)], "contig string, ord int")
    assert [(r["contig"], r["file_idx"]) for r in readers.merged_inputs(rows, rows.limit(1), contigs=order).collect()] == [("b", 0), ("b", 1), ("a", 0)]


def test_bytes_and_named_classes_in_filters(spark):
    df = spark.createDataFrame([("né",), ("A1",), ("",)], "x string")
    said = lambda text: [r["v"] for r in df.select(compile_filter(text, {"x": F.col("x")}, {"x"}).alias("v")).collect()]
    assert said("length(x) == 3") == [True, False, False]
    assert said("max(x) == 195") == [True, False, False]
    assert said("avg(x) < 60") == [False, True, False]
    assert said('x =~ "^[[:upper:]][[:digit:]]$"') == [False, True, False]


def test_headers_with_other_types_end_the_query(spark):
    kind = "file string, ord long, kind string, id string, text string"
    rows = [("f", 1, "INFO", "DP", "Type=Integer"), ("g", 1, "INFO", "DP", "Type=Integer,x"), ("g", 2, "FILTER", "q", "")]
    assert {(r["kind"], r["id"], r["place"], r["text"]) for r in variants.header_union(spark.createDataFrame(rows, kind)).collect()} == {("INFO", "DP", 1, "Type=Integer"), ("FILTER", "q", 1, "")}
    with pytest.raises(Exception, match="types differ"):
        variants.header_union(spark.createDataFrame([*rows, ("h", 1, "INFO", "DP", "Type=Float")], kind)).collect()
    with pytest.raises(ValueError, match="no such sample"):
        variants.sample_subset(spark.range(1), ["a"], ["b"])


def test_sites_side_by_side(spark):
    rows = [("f", "1", 5, "A", ["C"]), ("g", "1", 5, "A", ["G"]), ("g", "1", 5, "A", ["C"]), ("g", "1", 5, "A", ["AT"]), ("f", "1", 5, "A", []), ("f", "1", 6, "A", ["C", "AT"])]
    df = spark.createDataFrame(rows, "file string, chrom string, pos long, ref string, alts array<string>")
    sets = lambda how: sorted(tuple((m["file"], tuple(m["alts"])) for m in r["members"]) for r in variants.site_sync(df, how).collect())
    alone = [(("f", ()),), (("f", ("C", "AT")),), (("g", ("AT",)),)]
    assert sets("exact") == sorted([*alone, (("f", ("C",)), ("g", ("C",))), (("g", ("G",)),)])
    assert sets("both") == sorted([*alone, (("f", ("C",)), ("g", ("C",))), (("g", ("G",)),)])
    assert sets("snps") == sets("both")
    assert (("f", ("C",)), ("g", ("C",))) in sets("any")
    assert max(map(len, sets("any"))) == 2
    assert {(r["pos"], r["allele"], tuple(r["files"])) for r in variants.sharing_sites(df).collect()} == {(5, "A>C", ("f", "g")), (5, "A>G", ("g",)), (5, "A>AT", ("g",)), (6, "A>C", ("f",)), (6, "A>AT", ("f",))}


def test_merge_mode_keeps_what_nothing_holds(spark):
    tx = [("a", "c", "+", 1, [(1, 10), (20, 30)]), ("b", "c", "+", 5, [(5, 10), (20, 40)]), ("d", "c", "+", 22, [(22, 28)]), ("e", "c", "+", 25, [(25, 60)]), ("f", "c", "+", 50, [(50, 70)]), ("g", "c", "-", 22, [(22, 28)]), ("h", "c", "+", 900, [(900, 950)])]
    df = spark.createDataFrame(tx, f"id string, contig string, strand string, start long, exons {EX}")
    got = {r["first_id"]: (r["transcript_id"], [tuple(e) for e in r["exons"]], r["n"]) for r in transcripts.merge_isoforms(df, "id", "M", gap=100).collect()}
    # d lies in an exon of the chain, but its union with e and f does not
    assert got == {"a": ("M.1.1", [(1, 10), (20, 40)], 2), "d": ("M.1.2", [(22, 70)], 3), "h": ("M.2.1", [(900, 950)], 1), "g": ("M.3.1", [(22, 28)], 1)}


def test_parts(spark):
    parts = spark.createDataFrame([("k", "exon", 1, 5), ("k", "CDS", 6, 9), ("k", "CDS", 8, 12), ("k", "CDS", 13, 14), ("k", "exon", 30, 31), ("k", "exon", 30, 30)], "key string, kind string, start long, end long")
    assert sorted((r["start"], r["end"], r["kind"]) for r in hierarchy.joined_parts(parts).collect()) == [(1, 9, "CDS"), (8, 14, "CDS"), (30, 31, "exon")]


def test_records(spark):
    df = spark.createDataFrame([(1, "b\na", 3), (2, "c", 2), (3, None, 5)], "id long, text string, n long")
    assert [r["id"] for r in records.head_bytes(df, 5, "n", "id").collect()] == [1, 2]
    assert [r["id"] for r in records.from_nth(df, 2, "id").collect()] == [2, 3]
    assert {r["id"]: r["at"] for r in records.with_offsets(df, "id", "n", block=2).collect()} == {1: 0, 2: 3, 3: 5}
    assert [(r["id"], r["text"]) for r in records.grep_lines(df, "text", "a").collect()] == [(1, "a")]
    assert [r["id"] for r in records.grep(df, "text", "a", invert=True, most=1, order=("id",)).collect()] == [2]


def test_corrections_that_crowd_or_are_no_errors(spark):
    rng = random.Random(3)
    genome = "".join(rng.choice("ACGT") for _ in range(300))
    turn = dict(zip("ACGT", "CATG", strict=True))
    with_ = lambda *at: "".join(turn[c] if i in at else c for i, c in enumerate(genome))
    counts = kmers.count_kmers(spark.createDataFrame([(genome,)] * 4, ["seq"]), 13)
    reads = spark.createDataFrame([(1, with_(100, 103, 106)), (2, with_(100, 102, 104, 106)), (3, with_(50, 150, 250)), (4, genome)], "id long, seq string")
    got = {r["id"]: r for r in unitigs.correct_reads(reads, counts, 13, 2).collect()}
    assert (got[1]["seq"], got[1]["changes"], got[1]["cut"]) == (genome, 3, 0)
    assert (got[2]["seq"], got[2]["cut"]) == (genome[:100], 200)
    assert (got[3]["seq"], got[3]["changes"]) == (genome, 3)
    # a k-mer too rare to be trusted, but seen too often beside its alternative to be an error of that
    rare = with_(200)
    both = kmers.count_kmers(spark.createDataFrame([(genome,)] * 20 + [(rare,)] * 8, ["seq"]), 13)
    kept = unitigs.correct_reads(spark.createDataFrame([(5, rare)], "id long, seq string"), both, 13, 10).first()
    assert (kept["seq"], kept["changes"], kept["cut"]) == (rare, 0, 0)
    mended = unitigs.correct_reads(spark.createDataFrame([(5, rare)], "id long, seq string"), both, 13, 10, chance=0.0).first()
    assert (mended["seq"], mended["changes"]) == (genome, 1)
    bad = spark.createDataFrame([(genome[60:73],)], ["mer"])
    assert unitigs.correct_reads(reads, counts, 13, 2, contaminants=bad).count() == 0
    trimmed = unitigs.correct_reads(reads.filter("id = 4"), counts, 13, 2, contaminants=bad, trim=True).first()
    assert (trimmed["seq"], trimmed["cut"]) == (genome[:72], 228)
