"""Hot keys give the same numbers as plain windows."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.operators import positions as Pos
from waymark.operators import ranking
from waymark.sources.conversation_log import answer_edits
from waymark.sources.event_log import event_episodes


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with half of all rows, many of them at the same time."""
    n = F.col("id")
    return spark.range(6000).select(
        F.when(n % 2 == 0, 0).otherwise(n % 97).alias("k"),
        F.floor(n / 50).alias("t"),
        F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("id"),
        n.alias("v"),
    )


def test_positions(skewed):
    w = Window.partitionBy("k").orderBy("t", "id")
    want = skewed.select("k", "id", (F.row_number().over(w) - 1).cast("long").alias("pos"))
    got = Pos.with_positions(skewed, "k", ["t", "id"], hot_rows=500).select("k", "id", "pos")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_every_key_hot(skewed):
    w = Window.partitionBy("k").orderBy("t", "id")
    want = skewed.select("k", "id", (F.row_number().over(w) - 1).cast("long").alias("pos"))
    got = Pos.with_positions(skewed, "k", ["t", "id"], hot_rows=1).select("k", "id", "pos")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_previous_over_blocks(skewed):
    w = Window.partitionBy("k").orderBy("t", "id")
    want = skewed.select("k", "id", F.lag("v").over(w).alias("before"))
    got = Pos.with_previous(
        skewed, "k", ["t", "id"], {"before": "v"}, hot_rows=500
    ).select("k", "id", "before")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_bindings_do_not_depend_on_the_threshold(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plain, cut = event_episodes(events), event_episodes(events, hot_rows=20)
    assert plain.count() == cut.count() and plain.exceptAll(cut).isEmpty()
    talk = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    a, b = answer_edits(talk), answer_edits(talk, hot_bytes=1)
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_ranks_and_median(spark):
    values = [3.5, -1.0, 0.0, 0.0, 2.25, 2.25, 2.25, 7.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    counts = df.groupBy("v").agg(F.count("*").alias("n"))
    ranked = ranking.ranked_values(counts, "v", bins=2)
    got = {r["v"]: r["before"] for r in ranked.collect()}
    assert got == {-1.0: 0, 0.0: 1, 2.25: 3, 3.5: 6, 7.0: 7}
    assert ranked.agg(ranking.median_of("v")).first()[0] == 2.25


def test_previous_where_every_key_is_hot(skewed):
    w = Window.partitionBy("k").orderBy("t", "id")
    keyed = skewed.withColumn("k", F.when(F.col("k") > 5, F.col("k")))  # a key that is NULL, and hot
    want = keyed.select("k", "id", F.lag("v").over(w).alias("before"))
    got = Pos.with_previous(keyed, "k", ["t", "id"], {"before": "v"}, hot_rows=1).select("k", "id", "before")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_ranges_of_a_very_hot_key(spark):
    """A key of a thousand times the limit, and one below it; half of the hot rows share one time."""
    n = F.col("id")
    rows = spark.range(61_000).select(
        F.when(n < 60_000, "hot").otherwise("cold").alias("k"), F.when(n % 2 == 0, 7).otherwise(n).alias("t"), n.alias("id")
    )
    made = Pos._ranged(rows, ["k"], ["t", "id"], 60, None).filter("k = 'hot'").groupBy("_range").count().collect()
    sizes = sorted(r["count"] for r in made)
    assert 1500 < len(sizes) < 2500 and sizes[-1] <= 120 and sum(sizes) == 60_000
    got = Pos.with_positions(rows, "k", ["t", "id"], hot_rows=60)
    w = Window.partitionBy("k").orderBy("t", "id")
    assert got.withColumn("want", F.row_number().over(w) - 1).filter("pos <> want").isEmpty() and got.count() == 61_000


def test_load_in_bytes(spark):
    """Few long texts make a key hot where many short ones do not."""
    n = F.col("id")
    rows = spark.range(400).select(
        F.when(n < 40, "long").otherwise("short").alias("k"), n, F.repeat(F.lit("x"), F.when(n < 40, 1000).otherwise(3)).alias("text")
    )
    hot = Pos.hot_keys(rows, "k", 5_000, F.octet_length("text")).collect()
    assert [r["k"] for r in hot] == ["long"]
    got = Pos.with_positions(rows, "k", "id", hot_rows=5_000, load=F.octet_length("text"))
    w = Window.partitionBy("k").orderBy("id")
    assert got.withColumn("want", F.row_number().over(w) - 1).filter("pos <> want").isEmpty()


def test_no_job_runs_while_planning(spark, skewed):
    tracker, before = spark.sparkContext.statusTracker(), None
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        Pos.with_positions(skewed, "k", ["t", "id"], hot_rows=10)
        Pos.with_previous(skewed, "k", ["t", "id"], {"before": "v"}, hot_rows=10)
        assert len(tracker.getJobIdsForGroup("planning")) == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", before)
