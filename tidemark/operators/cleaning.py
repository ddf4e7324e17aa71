"""Cleaning of measurements and the audits that describe what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import joined_back, quantiles

KEYS = ("entity", "ts", "kind", "value", "unit")


def coerced(raw: DataFrame) -> DataFrame:
    """Text fields ``entity, ts, kind, value, unit`` as typed ones; rows whose time, value, entity or kind is not readable go."""
    typed = raw.select(
        "entity",
        F.expr("try_to_timestamp(ts)").cast("timestamp_ntz").alias("ts"),
        F.trim("kind").alias("kind"),
        F.expr("try_cast(value AS double)").alias("value"),
        "unit",
    )
    return typed.dropna(subset=["entity", "ts", "kind", "value"]).where(~F.isnan("value") & (F.abs("value") < float("inf")))


def clean(obs: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """One row per (entity, ts, kind, unit): ``value`` is the mean of the distinct values, ``n_raw`` how many there were.

    Rows of other kinds go, exact repeats count once, and only then units are trimmed and null units empty, so that rows
    whose units differ in blanks count each. Averages are partial before the shuffle on the group's own key.
    """
    kept = obs.where(F.col("kind").isin(*kinds)) if kinds else obs
    once = kept.dropDuplicates(list(KEYS)).withColumn("unit", F.trim(F.coalesce("unit", F.lit(""))))
    return once.groupBy("entity", "ts", "kind", "unit").agg(F.avg("value").alias("value"), F.count("*").alias("n_raw"))


def repeated_rows(obs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Groups of rows that agree in ``keys``, nulls included, with ``copies`` of two or more."""
    return obs.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def repeated_members(obs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The rows of ``repeated_rows`` themselves, with ``copies``, how many there are of their group."""
    return joined_back(obs, repeated_rows(obs, keys), keys, "copies")


def unit_mix(obs: DataFrame) -> DataFrame:
    """Per kind: rows, rows without a unit, distinct units, the commonest unit (ties: the smaller) and its share."""
    counted = obs.groupBy("kind", F.nullif(F.trim("unit"), F.lit("")).alias("unit")).agg(F.count("*").alias("n"))
    top = F.min(F.when(F.col("unit").isNotNull(), F.struct((-F.col("n")).alias("neg"), "unit")))
    rolled = counted.groupBy("kind").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("unit").isNull(), F.col("n"))), F.lit(0)).alias("n_without"), F.count("unit").alias("n_units"), top.alias("top"))
    return rolled.select("kind", "n_rows", "n_without", "n_units", F.col("top.unit").alias("top_unit"), F.round(-F.col("top.neg") / F.col("n_rows"), 6).alias("top_share"))


def spread(obs: DataFrame, by: str = "kind", value: str = "value") -> DataFrame:
    """Count, extremes and interpolated quantiles of a value per group."""
    shares = {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    return quantiles(obs, value, shares, (by,)).select(by, "n", "least", "most", *[F.round(p, 4).alias(p) for p in shares])


def history(obs: DataFrame) -> DataFrame:
    """Per entity: first and last time, rows, distinct kinds, and days between first and last."""
    rolled = obs.groupBy("entity").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_rows"), F.countDistinct("kind").alias("n_kinds"))
    return rolled.withColumn("days", F.datediff("last_ts", "first_ts"))


def described(frame: DataFrame, value: str) -> DataFrame:
    """One row: count, mean, sample deviation, extremes and quartiles of a column."""
    one = frame.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    cut = quantiles(frame, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return cut.join(F.broadcast(one)).select("n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "least", "most", *[F.round(p, 4).alias(p) for p in ("p25", "p50", "p75")])


def boundary(events: DataFrame, days: int = 90) -> DataFrame:
    """The last time of any event, and the last time at which ``days`` of future are known."""
    last = events.agg(F.max("ts").alias("last_event"))
    return last.withColumn("safe_cutoff", F.col("last_event") - F.make_interval(days=F.lit(days)))


def in_range(value: Column, low: Column, high: Column, default: tuple[float, float] = (0.0, 10_000.0)) -> Column:
    """Whether a value is plausible: within its kind's bounds, or the default ones where the kind has none."""
    return value.between(F.coalesce(low, F.lit(default[0])), F.coalesce(high, F.lit(default[1])))
