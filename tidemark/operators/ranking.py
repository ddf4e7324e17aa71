"""Ranks and running sums over all rows without a single-task window: totals of buckets first, then rows within a bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import stored

#: Buckets over which totals are carried; a table of this many rows for each group is all that is broadcast.
BUCKETS = 4096


def running(frame: DataFrame, bucket: Column, order: list[Column], sums: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """``frame`` with running sums (this row included) in the given order, within each group of ``by``.

    ``bucket`` is an integer that never falls along the order and takes at most ``BUCKETS`` values. Buckets' totals, at
    most that many for each group, are summed up by one small window and joined back; rows are summed within their bucket.
    """
    keyed = frame.withColumn("_bucket", bucket)
    totals = keyed.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    below = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*by, "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(below), F.lit(0)).alias(f"_c_{n}") for n in sums])
    within = W.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = keyed.select("*", *[F.sum(c).over(within).alias(f"_s_{n}") for n, c in sums.items()])
    joined = summed.join(F.broadcast(carried), [*by, "_bucket"])
    return joined.select(*frame.columns, *[(F.col(f"_c_{n}") + F.col(f"_s_{n}")).alias(n) for n in sums])


#: Even buckets: a row finds its bucket by this many coarse bounds, then by as many fine ones. The error of their ranks.
SIDE, ERROR = 16, 2000


def even_cuts(value: str) -> Column:
    """An aggregate: 255 bounds that deal rows into buckets of about equal size, whatever their values are.

    They come from a mergeable quantile sketch, whose ranks are wrong by at most one in ``ERROR``; of distinct values no
    bucket of ``bucket_of`` has more than 1/256 + 2/``ERROR``, under half a percent, outliers or not. A sketch depends on the
    order in which tasks end, so bounds that rows and totals are dealt by are to be written first.
    """
    return F.percentile_approx(value, F.array(*[F.lit(i / SIDE**2) for i in range(1, SIDE**2)]), ERROR)


def bucket_of(value: Column, cuts: Column) -> Column:
    """How many of ``even_cuts`` are below a value: an integer that never falls as the value rises."""
    under = lambda some: F.size(F.filter(some, lambda c: c < value))
    coarse = under(F.transform(F.sequence(F.lit(1), F.lit(SIDE - 1)), lambda i: cuts[i * SIDE - 1]))
    return coarse * SIDE + under(F.slice(cuts, coarse * SIDE + 1, SIDE - 1))


def quantiles(frame: DataFrame, value: str, shares: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, ``n, least, most`` and the named quantiles of a number, interpolated between its two nearest ranks.

    Distinct values are counted, written and dealt into even buckets; ranks are running counts over these, so a task has under half
    a percent of a group's distinct values, also where there are outliers. The bounds of each group, a row for each, are
    broadcast. Without values there is one row of nulls if ``by`` is empty.
    """
    at = frame.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    at = stored(at)  # the input is read once, not for the bounds, the totals and the ranks each
    ends = at.groupBy(*by).agg(F.coalesce(F.sum("_k"), F.lit(0)).alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"), even_cuts("_v").alias("_cuts"))
    ends = stored(ends)  # a sketch may differ when it is made again
    placed = at.join(F.broadcast(ends), list(by)) if by else at.join(F.broadcast(ends))
    placed = placed.withColumn("_at", bucket_of(F.col("_v"), F.col("_cuts"))).drop("_cuts")
    counted = running(placed, F.col("_at"), [F.col("_v")], {"_upto": F.col("_k")}, by)
    cuts = []
    for name, q in shares.items():
        place = q * (F.col("n") - 1)
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            cuts.append(F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_k") <= rank), F.col("_v"))).alias(f"_{name}_{side}"))
    rolled = counted.groupBy(*by).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("least").alias("least"), F.max("most").alias("most"), *cuts)
    between = lambda name, q: F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * (q * (F.col("n") - 1) - F.floor(q * (F.col("n") - 1)))
    return rolled.select(*by, "n", "least", "most", *[between(name, q).alias(name) for name, q in shares.items()])


def joined_back(rows: DataFrame, rolled: DataFrame, keys: tuple[str, ...], weight: str, heavy: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``rolled`` (one row for each group of ``keys``, nulls alike), by an inner join.

    ``weight`` counts the rows of a group. Groups of over one ``heavy``-th of all of them, fewer than ``heavy``, are sent to
    where the rows are; the others are joined by a shuffle. So no task gets all rows of a hot group.
    """
    named = rolled.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in rolled.columns if c not in keys])
    total = F.broadcast(named.agg(F.sum(weight).alias("_total")))
    sized = stored(named.join(total))  # counted once, for two branches
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    hot, cold = (sized.where(c).drop("_total") for c in (F.col(weight) * heavy > F.col("_total"), F.col(weight) * heavy <= F.col("_total")))
    lone = rows.join(F.broadcast(hot), same, "left_anti").join(cold, same)
    return rows.join(F.broadcast(hot), same).unionByName(lone).drop(*[f"_k{i}" for i in range(len(keys))])


def hash_order(*parts: Column, seed: int = 42) -> Column:
    """A reproducible order that depends on the row's content alone: 32 hexadecimal digits, the same in any SQL engine."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed))))


def hash_ranked(frame: DataFrame, key: str, by: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """``frame`` with its rank from 1 on by a hash column of hexadecimal digits, within each group of ``by``."""
    bucket = F.conv(F.substring(key, 1, 3), 16, 10).cast("int")
    return running(frame, bucket, [F.col(key)], {name: F.lit(1)}, by)
