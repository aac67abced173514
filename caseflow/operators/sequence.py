"""Skew-proof sequence helpers used instead of per-key windows.

A window partitioned by a key sends the whole key to one task.  These
helpers split each key into fixed-size sequence buckets, do the window work
inside (key, bucket), and stitch bucket borders through a much smaller table
of one row per bucket, so results are exact and a hot key spreads over many
tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_in_sequence(df: DataFrame, key: list[str], seq: str, value: str, out: str,
                     bucket_size: int = 4096) -> DataFrame:
    """Add ``out`` = ``value`` of the next row (by ``seq``) of the same key.

    ``seq`` must be numeric and unique within a key."""
    b = F.floor(F.col(seq) / bucket_size).cast("bigint")
    d = df.withColumn("_b", b)
    w = Window.partitionBy(*key, "_b").orderBy(seq)
    d = d.withColumn("_in", F.lead(F.col(value)).over(w))
    heads = d.groupBy(*key, "_b").agg(F.min_by(F.col(value), F.col(seq)).alias("_head"))
    # one row per bucket: the next non-empty bucket's head (per-key window over buckets only)
    wb = Window.partitionBy(*key).orderBy("_b")
    heads = heads.withColumn("_next_head", F.lead("_head").over(wb)).drop("_head")
    d = d.join(heads, [*key, "_b"], "left")
    return d.select(*[c for c in df.columns], F.coalesce(F.col("_in"), F.col("_next_head")).alias(out))


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, salt_buckets: int = 32,
                    salt_key: str | None = None) -> DataFrame:
    """Exact top-``n`` rows per group (ties broken by ``order`` fully).

    Phase 1 keeps the top n inside (group, salt) sub-groups, phase 2 ranks the
    at most ``salt_buckets * n`` survivors per group.  A hot group is split
    over ``salt_buckets`` tasks in phase 1."""
    salt_src = F.col(salt_key) if salt_key else F.struct(*[F.col(c) for c in df.columns])
    s = df.withColumn("_salt", F.pmod(F.hash(salt_src), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    s = s.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= n)
    w2 = Window.partitionBy(*group).orderBy(*order)
    s = s.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= n)
    return s.drop("_salt", "_r1")


def rank_by_counts(df: DataFrame, group: list[str], key: str, out: str, descending: bool = True) -> DataFrame:
    """SQL ``rank()`` of ``key`` within ``group`` without a window over rows.

    Rows are counted per distinct key; the rank is 1 plus the counts of the
    greater (smaller, ascending) keys: those of other days from day totals,
    those of the same day from a running sum over the day's distinct keys.  The
    ranks are joined back on (group, key), a join that splits skewed keys."""
    sign = -1 if descending else 1
    counts = df.groupBy(*group, key).agg(F.count("*").alias("_n")).withColumn("_day", F.to_date(F.col(key)))

    def order(c):
        return F.col(c).desc() if sign < 0 else F.col(c).asc()

    before = lambda *cols: Window.partitionBy(*group, *cols[:-1]).orderBy(order(cols[-1])).rowsBetween(
        Window.unboundedPreceding, -1)
    days = counts.groupBy(*group, "_day").agg(F.sum("_n").alias("_d")).withColumn(
        "_days", F.coalesce(F.sum("_d").over(before("_day")), F.lit(0))).drop("_d")
    within = counts.withColumn("_within", F.coalesce(F.sum("_n").over(before("_day", key)), F.lit(0)))
    ranks = within.join(days, [*group, "_day"]).select(
        *group, key, (F.col("_days") + F.col("_within") + 1).cast("bigint").alias(out))
    return df.join(ranks, [*group, key])


def last_value_before(values: DataFrame, probes: DataFrame, key: list[str], seq: str, value: str, out: str,
                      bucket_size: int = 4096) -> DataFrame:
    """As-of lookup: for each probe row, the ``value`` of the newest row of
    ``values`` with the same key and ``seq`` <= the probe's ``seq`` (values
    win ties).  Exact; a hot key is spread over sequence buckets."""
    b = F.floor(F.col(seq) / bucket_size).cast("bigint")
    v = values.select(*key, seq, F.col(value).alias("_v"), F.lit(0).alias("_side"))
    p = probes.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(values.schema[value].dataType))
    pcols = probes.columns
    u = p.unionByName(v, allowMissingColumns=True).withColumn("_b", b)
    w = Window.partitionBy(*key, "_b").orderBy(seq, "_side").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_in", F.last("_v", ignorenulls=True).over(w))
    tails = v.withColumn("_b", b).groupBy(*key, "_b").agg(F.max_by("_v", F.col(seq)).alias("_tail"))
    # one row per occupied bucket of either side; carry = last tail of an earlier bucket
    buckets = u.select(*key, "_b").distinct().join(tails, [*key, "_b"], "left")
    wb = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(*key, "_b", F.last("_tail", ignorenulls=True).over(wb).alias("_carry"))
    j = u.where(F.col("_side") == 1).join(buckets, [*key, "_b"], "left")
    return j.select(*pcols, F.coalesce("_in", "_carry").alias(out))


def exact_median(df: DataFrame, group: list[str], value: str, out: str, bucket_width: int = 1_000_000) -> DataFrame:
    """Exact median (same definition as ``percentile(v, 0.5)``: the mean of
    the two middle values for an even count) per group, without gathering a
    group's values in one task.

    Values are counted per (group, value bucket) with partial aggregation;
    the running count over buckets (a window over bucket rows only) finds
    the one or two buckets holding the middle ranks; of those, distinct values
    with their counts are walked, never rows."""
    d = df.select(*group, F.col(value).alias("_v")).where(F.col("_v").isNotNull()) \
        .withColumn("_b", F.floor(F.col("_v") / bucket_width).cast("bigint"))
    n = d.groupBy(*group).agg(F.count("*").alias("_n"))
    bc = d.groupBy(*group, "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bc = bc.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0))).join(n, group)
    lo = F.floor((F.col("_n") - 1) / 2)
    hi = F.ceil((F.col("_n") - 1) / 2)
    inside = lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c"))
    need = bc.where(inside(lo) | inside(hi)).select(*group, "_b", "_before", lo.alias("_lo"), hi.alias("_hi"))
    # distinct values with their counts: at most bucket_width rows a bucket
    values = (d.join(need, [*group, "_b"], "inner").groupBy(*group, "_b", "_before", "_lo", "_hi", "_v")
              .agg(F.count("*").alias("_m")))
    wr = Window.partitionBy(*group, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("_before") + F.col("_to")
    covers = lambda r: F.max(F.when((F.col(r) < end) & (F.col(r) >= end - F.col("_m")), F.col("_v")))
    return (values.withColumn("_to", F.sum("_m").over(wr)).groupBy(*group)
            .agg(((covers("_lo") + covers("_hi")) / 2).alias(out)))
