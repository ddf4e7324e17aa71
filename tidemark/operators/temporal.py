"""Joins along time within an entity: range joins by buckets, snapshots, look-ahead labels, as-of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_number(ts: Column | str) -> Column:
    return F.datediff(ts, F.lit("1970-01-01").cast("date"))


def range_join(points: DataFrame, events: DataFrame, before: int, after: int, at: str = "snap_ts", ts: str = "ts", open_start: bool = False) -> DataFrame:
    """Rows of ``events`` from ``before`` days before to ``after`` days after each point's time, within the same ``entity``.

    Both ends count, but for the start with ``open_start``. Time is cut into buckets as wide as the range, so a point looks
    into two or three of them and an entity with very many rows is spread over as many keys as it has buckets: the join is
    on (entity, bucket) with the exact bounds as a residual, and skew within a bucket is left to adaptive execution. Points
    without events have no rows.
    """
    width = max(1, before + after)
    bucket = lambda c: F.floor(c / F.lit(width)).cast("int")
    looks = F.sequence(bucket(day_number(at) - before - 1), bucket(day_number(at) + after + 1))
    left = points.withColumn("_bucket", F.explode(looks))
    right = events.withColumnRenamed("entity", "_entity").withColumn("_in", bucket(day_number(ts)))
    start, stop = F.col(at) - F.make_interval(days=F.lit(before)), F.col(at) + F.make_interval(days=F.lit(after))
    inside = (F.col(ts) > start if open_start else F.col(ts) >= start) & (F.col(ts) <= stop)
    joined = left.join(right, (F.col("entity") == F.col("_entity")) & (F.col("_bucket") == F.col("_in")) & inside)
    return joined.drop("_bucket", "_entity", "_in")


def gathered(points: DataFrame, events: DataFrame, before: int, at: str = "snap_ts", ts: str = "ts") -> DataFrame:
    """``range_join`` up to each point, with ``_bucket``: all rows of a point meet in one partition, so that groups of points need no shuffle.

    A point is in one bucket and it is the events that are repeated, once for each bucket that looks at them. Points without
    events stay, with nulls. For events whose number within an entity's bucket is bounded: one bucket is one key.
    """
    width = max(1, before)
    bucket = lambda c: F.floor(c / F.lit(width)).cast("int")
    left = points.withColumn("_bucket", bucket(day_number(at)))
    seen = F.sequence(bucket(day_number(ts) - 1), bucket(day_number(ts) + before + 1))
    right = events.withColumnRenamed("entity", "_entity").withColumn("_in", F.explode(seen))
    inside = (F.col(ts) >= F.col(at) - F.make_interval(days=F.lit(before))) & (F.col(ts) <= F.col(at))
    return left.join(right, (F.col("entity") == F.col("_entity")) & (F.col("_bucket") == F.col("_in")) & inside, "left").drop("_entity", "_in")


def snapshots(obs: DataFrame, every: int = 90, least_history: int = 90, cutoff: DataFrame | None = None) -> DataFrame:
    """``entity, snap_ts, first_ts, last_ts``: a time every ``every`` days from first + ``least_history`` to the last observation.

    The last one is no later than the single value in ``cutoff`` where given. Entities with less history have none.
    """
    span = obs.groupBy("entity").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_rows"), F.countDistinct("kind").alias("n_kinds"))
    end = F.col("last_ts")
    if cutoff is not None:
        span = span.join(F.broadcast(cutoff.select(F.col(cutoff.columns[0]).alias("_cut"))))  # one row
        end = F.least("last_ts", "_cut")
    start = F.col("first_ts") + F.make_interval(days=F.lit(least_history))
    step = F.expr(f"interval {every} days")
    series = F.when(start <= end, F.sequence(start, end, step))
    return span.select("entity", F.explode(series).alias("snap_ts"), "first_ts", "last_ts", "n_rows", "n_kinds").withColumn("history_days", F.datediff("snap_ts", "first_ts"))


def forward_labels(points: DataFrame, events: DataFrame, days: int = 90) -> DataFrame:
    """``points`` with ``label`` and ``first_event``: the earliest event strictly after the point and at most ``days`` later."""
    keys = points.select("entity", "snap_ts")
    first = range_join(keys, events.select("entity", "ts"), 0, days, open_start=True).groupBy("entity", "snap_ts").agg(F.min("ts").alias("first_event"))
    named = first.withColumnsRenamed({"entity": "_e", "snap_ts": "_a"})
    joined = points.join(named, (F.col("entity") == F.col("_e")) & (F.col("snap_ts") == F.col("_a")), "left").drop("_e", "_a")
    return joined.withColumn("label", F.col("first_event").isNotNull().cast("int"))


def spaced(points: DataFrame, keep: Column, order: str = "snap_ts") -> DataFrame:
    """Of each entity's rows, ``keep`` of them evenly spaced in time, first and last included; all where there are no more.

    Row i of the k kept is the one at ``round_half_even(i * (n - 1) / (k - 1))``. Rows are numbered within an entity.
    """
    from pyspark.sql import Window as W

    numbered = points.withColumn("_i", F.row_number().over(W.partitionBy("entity").orderBy(order)) - 1).withColumn("_n", F.count("*").over(W.partitionBy("entity")))
    numbered = numbered.withColumn("_k", keep.cast("int"))
    places = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda i: F.bround(i * (F.col("_n") - 1) / F.greatest(F.col("_k") - 1, F.lit(1)), 0).cast("int"))
    chosen = F.when(F.col("_k") >= F.col("_n"), True).when(F.col("_k") <= 0, False).otherwise(F.array_contains(places, F.col("_i")))
    return numbered.where(chosen).drop("_i", "_n", "_k")
