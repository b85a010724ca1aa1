import random
from pathlib import Path

from pyspark.sql import functions as F

from vigilume import session
from vigilume.functions import ordering
from vigilume.functions.ordering import ranked, running_totals, segmented


def test_totals_and_previous_across_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(1)
        keys = rng.sample(range(10_000), 400)
        rows = [(k, rng.randint(0, 5)) for k in keys]
        out = running_totals(spark.createDataFrame(rows, "k int, n long"), "k", {"up_to": F.col("n")}, previous=["n"])
        assert out.select("k").count() == 400
        got = {r["k"]: (r["up_to"], r["prev_n"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    total, before = 0, None
    for k, n in sorted(rows):
        total += n
        assert got[k] == (total, before)
        before = n


def test_rank_within_groups_puts_null_last(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("a", x) for x in ("q", None, "b", "z")] + [("b", x) for x in ("m", "c")]
        got = {(r["g"], r["v"]): r["place"] for r in ranked(spark.createDataFrame(rows, "g string, v string"), "v", "place", by=["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == {("a", "b"): 1, ("a", "q"): 2, ("a", "z"): 3, ("a", None): 4, ("b", "c"): 1, ("b", "m"): 2}


def brute_scan(rows):
    """(key, t, rank, x, mark) rows: running sum, last mark, x before, within the key."""
    out, by = [], {}
    for k, t, r, x, m in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        total, mark, before = by.get(k, (0, None, None))
        total, mark = total + (x or 0), m if m is not None else mark
        by[k] = (total, mark, x)
        out.append((k, t, r, total, mark, before))
    return out


def test_segmented_scans_carry_over_ranges(spark):
    rng = random.Random(4)
    for keys in (["a"], ["a", "b", None], [f"k{i}" for i in range(300)]):
        rows = [(rng.choice(keys), i, rng.randrange(2), rng.choice([1, 5, None]), rng.choice([None] * 9 + [i])) for i in range(900)]
        df = spark.createDataFrame(rows, "k string, t int, r int, x int, m int").repartition(3)
        got = segmented(df, ["k"], [F.col("t").asc(), F.col("r").asc()], totals={"sum": F.col("x")}, latest={"mark": F.col("m")}, previous={"before": F.col("x")})
        have = sorted(((r.k, r.t, r.r, r["sum"], r.mark, r.before) for r in got.collect()), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
        assert have == sorted(brute_scan(rows), key=lambda r: (r[0] is not None, r[0] or "", r[1]))


def test_segmented_descending_keeps_some_rows(spark):
    rows = [("a", i, i % 7 == 0) for i in range(500)] + [("b", i, False) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t int, off boolean")
    got = segmented(df, ["k"], [F.col("t").desc()], latest={"next": F.when(F.col("off"), F.col("t"))}, keep=~F.col("off"))
    expected = {("a", i): min((j for j in range(i, 500) if j % 7 == 0), default=None) for i in range(500) if i % 7} | {("b", i): None for i in range(500)}
    assert {(r.k, r.t): r.next for r in got.collect()} == expected


def test_segmented_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, t int")
    assert segmented(df, ["k"], [F.col("t").asc()], totals={"n": F.lit(1)}).collect() == []


def test_a_hot_key_is_spread_over_the_ranges(spark, monkeypatch):
    """Nine rows in ten have one key; no range, which is what a task scans, has more than twice the mean."""
    kept = []
    monkeypatch.setattr(ordering, "stored", lambda df, label: kept.append(ordering_stored(df, label)) or kept[-1])
    ordering_stored = session.stored
    df = spark.range(40_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), F.col("id").alias("t"))
    assert segmented(df, ["k"], [F.col("t").asc()], totals={"n": F.lit(1)}).where("k = 'hot'").agg(F.max("n")).first()[0] == 36_000
    sizes = [r["count"] for r in kept[0].groupBy("_range").count().collect()]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(sizes) == 40_000 and max(sizes) <= 2 * 40_000 / ranges


def test_discarded_tables_are_deleted(spark):
    kept, gone = session.stored(spark.range(5), "kept"), session.stored(spark.range(7), "gone")
    session.discard(gone)
    assert kept.count() == 5 and not Path(gone._stored_at).exists() and Path(kept._stored_at).exists()
