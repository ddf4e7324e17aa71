"""Point-in-time statistics of each kind of measurement before a snapshot, in long and wide form, and what they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.temporal import gathered, range_join

#: The statistics of a kind, in the order of the wide form.
STATISTICS = ("latest", "mean_long", "min_long", "max_long", "std_long", "mean_short", "slope_long", "slope_short", "abs_change", "rel_change", "days_since", "missing")
#: Below this a first value is taken for zero and has no relative change.
TINY = 1e-12


def relative(first: Column, last: Column) -> Column:
    """Change against the size of the first value; null where that is zero."""
    return F.when(F.abs(first) >= TINY, (last - first) / F.abs(first))


def daily(obs: DataFrame) -> DataFrame:
    """``entity, ts (day), kind, value``: the median of each entity's values of a kind on a day."""
    return obs.groupBy("entity", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), "kind").agg(F.median("value").alias("value"))


def long_block(points: DataFrame, obs: DataFrame, mode: str = "train", long_days: int = 365, short_days: int = 90) -> DataFrame:
    """One row per (entity, snap_ts, kind) with values in the last ``long_days``: the twelve statistics but ``missing``.

    ``mode="train"``: medians per day; population deviation; no change from a single value; whole days since the latest.
    ``mode="serve"``: values as they are, ties in time going to the larger value; sample deviation (null for one value);
    a single value changed by 0; the latest value and the days since it look at all history up to the point.
    """
    if mode == "train":
        # days have one value of a kind, so what meets in a bucket is bounded and groups can stay where points met their values
        keys = points.select("entity", F.date_trunc("day", "snap_ts").cast("timestamp_ntz").alias("snap_ts")).distinct()
        return _rolled(gathered(keys, daily(obs), long_days).where("kind is not null"), mode, short_days, ["entity", "_bucket", "snap_ts"]).drop("_bucket")
    if mode != "serve":
        raise ValueError(f"mode is train or serve, not {mode}")
    keys, values = points.select("entity", "snap_ts").distinct(), obs.select("entity", "ts", "kind", "value")
    block = _rolled(range_join(keys, values, long_days, 0), mode, short_days, ["entity", "snap_ts"])
    # a kind whose values are all older than the long window still has a latest one; a backward as-of by union and a running maximum
    block = block.drop("latest", "days_since").join(latest_before(keys, values), ["entity", "snap_ts", "kind"], "right")
    return block.select("entity", "snap_ts", "kind", F.coalesce("n_long", F.lit(0)).alias("n_long"), *STATISTICS[:11])


def _rolled(met: DataFrame, mode: str, short_days: int, by: list[str]) -> DataFrame:
    """The statistics of values that met their points, one row for each of ``by`` and kind."""
    day = F.datediff("ts", F.col("snap_ts")).cast("double")
    recent = F.col("ts") >= F.col("snap_ts") - F.make_interval(days=F.lit(short_days))
    first, last = F.min(F.struct("ts", "value"))["value"], F.max(F.struct("ts", "value"))["value"]
    rolled = met.groupBy(*by, "kind").agg(
        F.count("ts").alias("n_long"),
        last.alias("latest"),
        F.avg("value").alias("mean_long"),
        F.min("value").alias("min_long"),
        F.max("value").alias("max_long"),
        (F.stddev_pop("value") if mode == "train" else F.stddev_samp("value")).alias("std_long"),
        F.avg(F.when(recent, F.col("value"))).alias("mean_short"),
        F.regr_slope("value", day).alias("slope_long"),
        F.regr_slope(F.when(recent, F.col("value")), day).alias("slope_short"),
        first.alias("_first"),
        F.max("ts").alias("_last_ts"),
    )
    change, rate = F.col("latest") - F.col("_first"), relative(F.col("_first"), F.col("latest"))
    if mode == "train":
        change, rate = F.when(F.col("n_long") > 1, change), F.when(F.col("n_long") > 1, rate)
    since = F.datediff("snap_ts", "_last_ts") if mode == "train" else F.greatest(F.lit(0.0), F.timestamp_diff("SECOND", F.col("_last_ts"), F.col("snap_ts")) / F.lit(86400.0))
    return rolled.select(*by, "kind", "n_long", *STATISTICS[:8], change.alias("abs_change"), rate.alias("rel_change"), since.cast("double").alias("days_since"))


def latest_before(keys: DataFrame, values: DataFrame) -> DataFrame:
    """``entity, snap_ts, kind, latest, days_since`` over all history: a backward as-of join.

    Per entity and kind the values and the points are one series, in which each point takes the last value met. Points are
    repeated for the kinds their entity has.
    """
    from pyspark.sql import Window as W

    kinds = values.select("entity", "kind").distinct()
    ask = keys.join(kinds, "entity").select("entity", "kind", F.col("snap_ts").alias("ts"), F.lit(None).cast("double").alias("value"), F.lit(1).alias("asked"))
    series = values.select("entity", "kind", "ts", "value", F.lit(0).alias("asked")).unionByName(ask)
    before = W.partitionBy("entity", "kind").orderBy("ts", "asked", "value").rowsBetween(W.unboundedPreceding, 0)
    seen = series.withColumn("_m", F.last(F.when(F.col("asked") == 0, F.struct("ts", "value")), ignorenulls=True).over(before))
    seen = seen.where("asked = 1 AND _m IS NOT NULL")
    since = F.greatest(F.lit(0.0), F.timestamp_diff("SECOND", F.col("_m.ts"), F.col("ts")) / F.lit(86400.0))
    return seen.select("entity", F.col("ts").alias("snap_ts"), "kind", F.col("_m.value").alias("latest"), since.alias("days_since"))


def feature_names(kinds: tuple[str, ...]) -> list[str]:
    """Names of the wide form, kind by kind, in the order that models rely on."""
    return [f"{k}__{s}" for k in kinds for s in STATISTICS]


def wide(points: DataFrame, block: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """One row per point with a column for each kind and statistic, in contract order; points without values have nulls."""
    picks = [F.max(F.when(F.col("kind") == k, F.col(s))).alias(f"{k}__{s}") for k in kinds for s in STATISTICS[:-1]]
    rows = block.groupBy("entity", "snap_ts").agg(*picks)
    joined = points.join(rows, ["entity", "snap_ts"], "left")
    missing = {f"{k}__missing": F.col(f"{k}__latest").isNull().cast("double") for k in kinds}
    names = feature_names(kinds)
    return joined.select(*points.columns, *[missing[n].alias(n) if n in missing else F.col(n) for n in names])


def wide_at(points: DataFrame, obs: DataFrame, kinds: tuple[str, ...], long_days: int = 365, short_days: int = 90) -> DataFrame:
    """``wide`` of distinct points and their ``long_block`` for training, which are kept in one partition from their join on.

    All columns of ``points`` (each at the beginning of a day) are kept. A kind's statistics travel as one struct: a maximum
    for each kind, not one for each column.
    """
    keys = [c for c in points.columns if c not in ("entity", "snap_ts")]
    by = ["entity", "_bucket", "snap_ts", *keys]
    block = _rolled(gathered(points, daily(obs), long_days), "train", short_days, by)
    rows = block.groupBy(*by).agg(*[F.max(F.when(F.col("kind") == k, F.struct(*STATISTICS[:-1]))).alias(f"_{i}") for i, k in enumerate(kinds)])
    column = lambda i, s: F.col(f"_{i}.latest").isNull().cast("double") if s == "missing" else F.col(f"_{i}.{s}")
    return rows.select(*points.columns, *[column(i, s).alias(f"{k}__{s}") for i, k in enumerate(kinds) for s in STATISTICS])


def check_contract(frame: DataFrame, names: list[str]) -> None:
    """An error unless the frame has these feature columns in this order and no other ones."""
    found = [c for c in frame.columns if "__" in c]
    if found != names:
        absent, extra = [n for n in names if n not in found], [n for n in found if n not in names]
        raise ValueError(f"feature contract broken: absent {absent[:5]}, extra {extra[:5]}, order {'same' if set(found) != set(names) else 'differs'}")


def safe_names(names: list[str]) -> dict[str, str]:
    """Names free of characters that models reject; equal results are told apart by a number behind them."""
    import re

    out: dict[str, str] = {}
    used: dict[str, int] = {}
    for name in names:
        plain = re.sub(r"_+", "_", re.sub(r"[^0-9A-Za-z_]", "_", name)).strip("_") or "feature"
        used[plain] = used.get(plain, 0) + 1
        out[name] = plain if used[plain] == 1 else f"{plain}_{used[plain]}"
    return out


def coverage(wide_frame: DataFrame, names: list[str]) -> DataFrame:
    """``entity, snap_ts, n_features, n_filled, coverage``: the share of a row's features that have a value."""
    filled = sum((F.col(f"`{n}`").isNotNull().cast("int") for n in names[1:]), F.col(f"`{names[0]}`").isNotNull().cast("int"))
    return wide_frame.select("entity", "snap_ts", F.lit(len(names)).alias("n_features"), filled.alias("n_filled"), F.round(filled / F.lit(len(names)), 6).alias("coverage"))


def progression(obs: DataFrame, short_days: int = 90, long_days: int = 365) -> DataFrame:
    """How each kind went for each entity over all its history, as seen from the entity's last measurement."""
    ends = obs.groupBy("entity").agg(F.max("ts").alias("ref"))
    seen = obs.join(ends, "entity")
    day = F.timestamp_diff("SECOND", F.col("ref"), F.col("ts")) / F.lit(86400.0)
    since = lambda n: F.count(F.when(F.col("ts") >= F.col("ref") - F.make_interval(days=F.lit(n)), 1))
    rolled = seen.groupBy("entity", "kind").agg(
        F.count("*").alias("records"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("latest_ts"),
        F.min(F.struct("ts", "value"))["value"].alias("first_value"),
        F.max(F.struct("ts", "value"))["value"].alias("latest_value"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.regr_slope("value", day).alias("slope_per_day"),
        since(short_days).alias("records_short"),
        since(long_days).alias("records_long"),
        F.min("ref").alias("ref"),
    )
    first, last = F.col("first_value"), F.col("latest_value")
    days = lambda a, b: F.timestamp_diff("SECOND", F.col(a), F.col(b)) / F.lit(86400.0)
    return rolled.select(
        *rolled.columns[:-1],
        (last - first).alias("absolute_change"),
        (relative(first, last) * 100).alias("percent_change"),
        trend(first, last).alias("trend"),
        days("first_ts", "latest_ts").alias("history_days"),
        days("latest_ts", "ref").alias("days_since_latest"),
    )


def trend(first: Column, last: Column, steady: float = 0.02) -> Column:
    """STABLE where the change is under 2 % of the larger value (1 at least), else INCREASING or DECREASING."""
    scale = F.greatest(F.abs(first), F.abs(last), F.lit(1.0))
    return F.when(first.isNull() | last.isNull(), "UNKNOWN").when(F.abs(last - first) / scale < steady, "STABLE").when(last > first, "INCREASING").otherwise("DECREASING")


def history_confidence(obs: DataFrame, coverage_of: DataFrame | None = None) -> DataFrame:
    """Per entity: a score in 0..1 for how much history there is, and its band.

    ``coverage_of`` (``entity, coverage``) adds the share of features filled; without it that part counts as zero.
    """
    rolled = obs.groupBy("entity").agg(
        F.count("*").alias("records"), F.countDistinct("kind").alias("kinds"), F.countDistinct(F.to_date("ts")).alias("dates"), (F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")) / F.lit(86400.0)).alias("days")
    )
    if coverage_of is not None:
        rolled = rolled.join(coverage_of.select("entity", "coverage"), "entity", "left")
    else:
        rolled = rolled.withColumn("coverage", F.lit(0.0))
    upto = lambda c, n: F.least(F.col(c) / F.lit(float(n)), F.lit(1.0))
    score = 0.20 * upto("records", 30) + 0.20 * upto("kinds", 10) + 0.25 * upto("dates", 5) + 0.20 * upto("days", 365) + 0.15 * F.coalesce("coverage", F.lit(0.0))
    kept = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)
    return rolled.select("entity", "records", "kinds", "dates", kept.alias("score"), F.when(kept >= 0.80, "HIGH").when(kept >= 0.55, "MODERATE").otherwise("LIMITED").alias("band"))
