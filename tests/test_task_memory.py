"""Steps that keep one task's rows few, or make a value once."""

import random

from pyspark.sql import functions as F

from strandline.operators import intervals, records, stored, transcripts
from strandline.sources import readers


def test_from_nth_takes_no_rows_through_one_task(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(9)]), i) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b int")
    key = lambda r: (r[0] is not None, r[0] or 0)
    for n in (0, 1, 2, 7, 30, 60, 61, 99):
        got = [tuple(r) for r in records.from_nth(df, n, "a").collect()]
        assert [key(r) for r in got] == sorted(map(key, rows))[max(n - 1, 0) :]
        assert len(set(got)) == len(got)
        assert set(got) <= set(rows)
        assert [tuple(r) for r in records.from_nth(df, n, "a", "b").collect()] == sorted(rows, key=lambda r: (key(r), r[1]))[max(n - 1, 0) :]
    assert "offset" not in records.from_nth(df, 7, "a", "b")._jdf.queryExecution().executedPlan().toString().lower()


def test_united_equals_merged_in_one_aggregation(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(12), "+", s, s + rng.choice([0, 4, 30, -1])) for s in (rng.randrange(120) for _ in range(90))]
    df = spark.createDataFrame(rows, "tx long, strand string, start long, end long")
    for gap in (0, 1, 5):
        got = transcripts.united(df, "tx", ("strand",), gap)
        flat = got.select("tx", F.inline("exons").alias("start", "end"))
        assert sorted(flat.collect()) == sorted(intervals.merged(df, gap, ("tx",), block=None).select("tx", "start", "end").collect())
        assert all((r["start"], r["end"]) == (r["exons"][0]["start"], r["exons"][-1]["end"]) for r in got.collect())
    plan = transcripts.united(df, "tx")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert plan.count("Exchange hashpartitioning") <= 1


def test_attributes_are_taken_apart_once(spark):
    line = "\t".join(["c", "s", "transcript", "1", "9", ".", "+", ".", "ID=a;k=1;k=2;exons=1-3,5-9"])
    df = spark.createDataFrame([(line,)], ["value"])
    assert readers.parse_gff(df).first()["attrs"] == {"ID": "a", "k": "1", "exons": "1-3,5-9"}
    entries = F.transform(F.split("value", ";"), lambda x: F.struct(x.alias("key"), x.alias("value")))
    plan = df.select(readers._first_of_each(entries).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1


def test_distinct_nascents_pass_in_batches(spark):
    rng, rows = random.Random(6), []
    for i in range(90):
        at, exons = rng.choice((100, 105, 180)), []
        for _ in range(rng.randint(1, 3)):
            exons.append((at, at + rng.choice((400, 402, 480))))
            at = exons[-1][1] + rng.choice((300, 301))
        rows.append((i, rng.choice("ab"), rng.choice("+-."), exons))
    tx = spark.createDataFrame(rows, f"id long, contig string, strand string, exons {transcripts.EXONS}")
    whole = sorted(transcripts.distinct_nascents(tx, "id").collect())
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(size)
    try:
        for n in ("1", "2", "7"):  # groups go on from batch to batch
            spark.conf.set(size, n)
            assert sorted(transcripts.distinct_nascents(tx, "id").collect()) == whole
    finally:
        spark.conf.set(size, old)
    plan = transcripts.distinct_nascents(tx, "id")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan  # no call a group


def test_united_deals_by_size_not_by_the_session(spark, tmp_path, monkeypatch):
    x = spark.range(6000).selectExpr("id % 900 tx", "'+' strand", "id * 37 % 5000 start", "id * 37 % 5000 + id % 60 end")
    x.write.parquet(str(tmp_path / "x"))
    x = spark.read.parquet(str(tmp_path / "x"))
    want = sorted(transcripts.united(x, "tx", ("strand",)).collect())
    monkeypatch.setattr(stored, "TASK_BYTES", 1 << 10)
    got = transcripts.united(x, "tx", ("strand",))
    assert got.rdd.getNumPartitions() > 20  # of 4 that the session sets
    assert sorted(got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan.rsplit("Exchange", 1)[1]  # no partial aggregation sorts the rows ahead of the shuffle


def test_merge_isoforms_makes_its_input_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(start):
        made.add(1)
        return start

    rows = [(i, "c", "+-"[i % 2], i * 30, [(i * 30, i * 30 + 20), (i * 30 + 50, i * 30 + 90)][: 1 + i % 3 % 2]) for i in range(40)]
    tx = spark.createDataFrame(rows, f"tx long, contig string, strand string, start long, exons {transcripts.EXONS}")
    made_once = F.udf(seen, "long").asNondeterministic()("start")
    assert transcripts.merge_isoforms(tx.withColumn("start", made_once), "tx").count() > 1
    assert made.value == len(rows)
