"""Whether a kind of measurement got better or worse, and an entity as a whole."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import relative


@dataclass(frozen=True)
class Concern:
    """How a kind is judged: which direction is worse (``higher``, ``lower``, ``neutral``), and the least change that counts."""

    direction: str
    least_change: float


def by_kind(obs: DataFrame, concerns: dict[str, Concern], days: int = 730, least_relative: float = 0.03) -> DataFrame:
    """One row per entity and kind in ``concerns``: change over the last ``days`` up to the entity's last measurement.

    Statuses: INSUFFICIENT_HISTORY (under two values, or all on one day), STABLE, WORSENING, IMPROVING, CHANGING_NEUTRAL.
    """
    ends = obs.groupBy("entity").agg(F.max("ts").alias("_ref"))
    seen = obs.where(F.col("kind").isin(*concerns)).join(ends, "entity").where(F.col("ts") >= F.col("_ref") - F.make_interval(days=F.lit(days)))
    rolled = seen.groupBy("entity", "kind").agg(
        F.min(F.struct("ts", "value")).alias("_first"), F.max(F.struct("ts", "value")).alias("_last"), F.count("*").alias("points"), F.regr_slope("value", F.datediff("ts", "_ref").cast("double")).alias("slope_per_day")
    )
    first, last, span = F.col("_first.value"), F.col("_last.value"), F.datediff("_last.ts", "_first.ts")
    table = F.create_map(*[x for k, c in concerns.items() for x in (F.lit(k), F.struct(F.lit(c.direction).alias("direction"), F.lit(c.least_change).alias("least")))])
    concern = table[F.col("kind")]
    change, rate = last - first, relative(first, last)
    short = (F.col("points") < 2) | (span <= 0)
    confidence = F.when(short, "LOW").when((F.col("points") >= 3) & (span >= 90), "HIGH").when(span >= 30, "MEDIUM").otherwise("LOW")
    counts = (F.abs(change) >= concern["least"]) & F.coalesce(F.abs(rate) >= least_relative, F.lit(False))
    worse = F.when(concern["direction"] == "higher", change > 0).when(concern["direction"] == "lower", change < 0)
    status = F.when(short, "INSUFFICIENT_HISTORY").when(~counts, "STABLE").when(worse.isNull(), "CHANGING_NEUTRAL").when(worse, "WORSENING").otherwise("IMPROVING")
    return rolled.select(
        "entity", "kind", first.alias("first_value"), last.alias("latest_value"), change.alias("absolute_change"), rate.alias("relative_change"), "slope_per_day", span.alias("days_covered"), "points",
        confidence.alias("confidence"), status.alias("status"),
    )


def _score(status: Column) -> Column:
    return F.when(status == "WORSENING", 1.0).when(status == "IMPROVING", -1.0).otherwise(0.0)


def overall(kinds: DataFrame, least_signals: int = 2) -> DataFrame:
    """One row per entity: the mean of its kinds' directions, weighted by confidence (1, 0.7, 0.4), and what follows from it."""
    usable = F.col("status").isin("WORSENING", "IMPROVING", "STABLE")
    weight = F.when(F.col("confidence") == "HIGH", 1.0).when(F.col("confidence") == "MEDIUM", 0.7).otherwise(0.4)
    count = lambda c: F.count(F.when(c, 1))
    rolled = kinds.groupBy("entity").agg(
        count(usable).alias("signals"),
        count(F.col("status") == "WORSENING").alias("worsening"),
        count(F.col("status") == "IMPROVING").alias("improving"),
        count(F.col("status") == "STABLE").alias("stable"),
        count(F.col("status") == "CHANGING_NEUTRAL").alias("neutral"),
        count(usable & (F.col("confidence") == "HIGH")).alias("high"),
        F.sum(F.when(usable, _score(F.col("status")) * weight)).alias("_weighted"),
        F.sum(F.when(usable, weight)).alias("_weight"),
    )
    enough = F.col("signals") >= least_signals
    score = F.round(F.col("_weighted") / F.col("_weight"), 6)
    status = F.when(~enough, "INSUFFICIENT_DATA").when(score >= 0.25, "WORSENING").when(score <= -0.25, "IMPROVING").otherwise("STABLE")
    confidence = F.when(~enough, "LOW").when((F.col("signals") >= 5) & (F.col("high") >= 3), "HIGH").when(F.col("signals") >= 3, "MEDIUM").otherwise("LOW")
    zero = lambda c: F.when(enough, F.col(c)).otherwise(F.lit(0)).alias(c)
    return rolled.select("entity", status.alias("status"), confidence.alias("confidence"), "signals", zero("worsening"), zero("improving"), zero("stable"), zero("neutral"), F.when(enough, F.round(score, 3)).alias("score"))
