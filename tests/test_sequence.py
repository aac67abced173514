"""The bucketed sequence helpers equal plain window results, also when keys
span many buckets (tiny bucket sizes force the cross-bucket paths)."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from caseflow.operators.sequence import rank_by_counts, last_value_before, next_in_sequence, top_n_per_group


def _data(spark, n=400, keys=4, seed=1):
    rnd = random.Random(seed)
    rows, used = [], set()
    while len(rows) < n:
        k, s = f"k{rnd.randint(0, keys - 1)}", rnd.randint(0, 5000)
        if (k, s) in used:
            continue
        used.add((k, s))
        rows.append((k, s, rnd.randint(0, 99)))
    return spark.createDataFrame(rows, "k string, s long, v long")


def test_next_in_sequence(spark):
    df = _data(spark)
    got = next_in_sequence(df, ["k"], "s", "v", "nxt", bucket_size=7)
    want = df.withColumn("nxt", F.lead("v").over(Window.partitionBy("k").orderBy("s")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_last_value_before(spark):
    df = _data(spark)
    values = df.where(F.col("v") % 3 == 0)
    probes = df.where(F.col("v") % 3 != 0).select("k", "s")
    got = {(r["k"], r["s"]): r["h"] for r in
           last_value_before(values, probes, ["k"], "s", "v", "h", bucket_size=5).collect()}
    vals = sorted((r["k"], r["s"], r["v"]) for r in values.collect())
    for (k, s), h in got.items():
        prior = [v for kk, ss, v in vals if kk == k and ss <= s]
        assert h == (prior[-1] if prior else None)
    assert len(got) == probes.count()


def test_top_n_per_group(spark):
    df = _data(spark, keys=2)
    got = top_n_per_group(df, ["k"], [F.col("v").desc(), F.col("s")], 5, salt_buckets=8, salt_key="s")
    w = Window.partitionBy("k").orderBy(F.col("v").desc(), F.col("s"))
    want = df.withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    assert sorted(map(tuple, got.select("k", "s", "v", "rank").collect())) == \
        sorted(map(tuple, want.select("k", "s", "v", "rank").collect()))


def test_rank_by_day_buckets(spark):
    df = _data(spark).unionByName(_data(spark)).withColumn("ts", F.timestamp_seconds(F.col("s") * 3600).cast("timestamp_ntz"))
    got = rank_by_counts(df, ["k"], "ts", "r")
    want = df.withColumn("r", F.rank().over(Window.partitionBy("k").orderBy(F.col("ts").desc())))
    assert sorted((r["k"], r["s"], r["r"]) for r in got.collect()) == \
        sorted((r["k"], r["s"], r["r"]) for r in want.collect())


def test_rank_of_one_group_on_one_day(spark):
    """The skewed case: every row in one group and day, many of them equal."""
    df = spark.range(3000).select(F.lit("k").alias("k"), F.col("id").alias("s"), F.timestamp_seconds(
        F.col("id") % 700).cast("timestamp_ntz").alias("ts"))
    got = rank_by_counts(df, ["k"], "ts", "r", descending=False)
    want = df.withColumn("r", F.rank().over(Window.partitionBy("k").orderBy("ts")))
    assert sorted((r["s"], r["r"]) for r in got.collect()) == sorted((r["s"], r["r"]) for r in want.collect())


def test_exact_median(spark):
    from caseflow.operators.sequence import exact_median
    df = _data(spark, n=301, keys=3)
    got = {r["k"]: r["m"] for r in exact_median(df, ["k"], "s", "m", bucket_width=50).collect()}
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.median("s").alias("m")).collect()}
    assert got == want
