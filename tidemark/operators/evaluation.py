"""Reports on scores: confusion and sweeps, areas, calibration, subgroups, and the multi-class equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ranking import bucket_of, even_cuts, hash_order, hash_ranked, joined_back, quantiles, running
from tidemark.session import stored

#: Thresholds of a sweep.
THRESHOLDS = (0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80)


def _ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    return F.round(F.when(b != 0, a / b).otherwise(F.lit(otherwise).cast("double")), 6)


def rates(counts: DataFrame, no_negatives: float | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1, specificity and negative predictive value from ``tn, fp, fn, tp``.

    Ratios over nothing are 0, specificity without negatives is ``no_negatives``.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        *counts.columns,
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tn, tn + fp, no_negatives).alias("specificity"),
        _ratio(tn, tn + fn).alias("npv"),
    )


def _cells(said: Column) -> list[Column]:
    yes = F.col("label") == 1
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    return [count(~said & ~yes, "tn"), count(said & ~yes, "fp"), count(~said & yes, "fn"), count(said & yes, "tp")]


def confusion(scored: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """Confusion cells and rates at one threshold, for all rows or for each group."""
    return rates(scored.groupBy(*by).agg(*_cells(F.col("p") >= threshold)))


def sweep(scored: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Confusion cells and rates at each threshold. One pass: all thresholds are aggregates of the same scan."""
    cells = [c.alias(f"{n}_{i}") for i, t in enumerate(thresholds) for c, n in zip(_cells(F.col("p") >= t), ("tn", "fp", "fn", "tp"), strict=True)]
    one = scored.agg(*cells)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), *[F.col(f"{n}_{i}").alias(n) for n in ("tn", "fp", "fn", "tp")]) for i, t in enumerate(thresholds)])
    return rates(one.select(F.inline(rows)))


def best(swept: DataFrame) -> DataFrame:
    """The threshold of highest F1, then highest recall, then the lowest one."""
    return swept.orderBy(F.desc("f1"), F.desc("recall"), "threshold").limit(1)


def _cumulated(scored: DataFrame) -> DataFrame:
    """Positives and negatives at each distinct score and above, by running sums over even buckets of scores."""
    at = scored.groupBy("p").agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).alias("neg"))
    cuts = stored(at.agg(even_cuts("p").alias("_cuts")))
    placed = at.join(F.broadcast(cuts)).withColumn("_at", -bucket_of(F.col("p"), F.col("_cuts"))).drop("_cuts")
    return running(placed, F.col("_at"), [F.desc("p")], {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")}).drop("_at")


def areas(scored: DataFrame) -> DataFrame:
    """One row: positives, negatives, the area under the ROC curve (ties count half), and average precision."""
    cum = _cumulated(scored)
    pairs = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos")) + 0.5 * F.col("neg") * F.col("pos"))
    step = F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    one = cum.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), pairs.alias("_pairs"), step.alias("_step"))
    return one.select("n_pos", "n_neg", F.round(F.try_divide("_pairs", F.col("n_pos") * F.col("n_neg")), 6).alias("roc_auc"), F.round(F.try_divide("_step", "n_pos"), 6).alias("avg_precision"))


def brier(scored: DataFrame) -> DataFrame:
    """One row: mean squared distance of scores from labels, mean score, positive rate."""
    return scored.agg(F.count("*").alias("n"), F.round(F.avg((F.col("p") - F.col("label")) * (F.col("p") - F.col("label"))), 6).alias("brier"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("label"), 6).alias("base_rate"))


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score against positive rate in bins between the score's interpolated quantiles.

    Equal edges are one edge; bins are closed on the right, the first one on both sides. Only the edges are broadcast.
    """
    cuts = quantiles(scored, "p", {f"q{i}": i / bins for i in range(bins + 1)})
    edges = cuts.select(F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(bins + 1)])).alias("edges"))
    below = F.size(F.filter("edges", lambda e: e < F.col("p")))
    placed = scored.join(F.broadcast(edges)).withColumn("bin", F.greatest(below, F.lit(1)))
    rolled = placed.groupBy("bin").agg(F.count("*").alias("n"), F.min("p").alias("least"), F.max("p").alias("most"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("label"), 6).alias("rate"))
    return rolled.withColumn("gap", F.round(F.abs(F.col("mean_p") - F.col("rate")), 5))


def by_size(scored: DataFrame, size: Column, limits: tuple[int, ...] = (1, 3, 10), threshold: float = 0.5) -> DataFrame:
    """Confusion and rates in classes of a count (up to 1, 3, 10, above); classes without rows are kept."""
    names = [f"{a + 1}-{b}" if a + 1 < b else str(b) for a, b in zip((0, *limits[:-1]), limits, strict=True)] + [f">{limits[-1]}"]
    which = F.lit(len(limits))
    for i in reversed(range(len(limits))):
        which = F.when(size <= limits[i], i).otherwise(which)
    counted = scored.withColumn("_class", which).groupBy("_class").agg(F.count("*").alias("n"), *_cells(F.col("p") >= threshold))
    all_classes = scored.sparkSession.createDataFrame(list(enumerate(names)), "_class int, size_class string")
    filled = all_classes.join(counted, "_class", "left").select("size_class", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "tn", "fp", "fn", "tp")])
    return rates(filled)


def by_entity(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per entity: rows, positive rate, rate of positive calls, mean and highest score."""
    called = F.avg((F.col("p") >= threshold).cast("int"))
    return scored.groupBy("entity").agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("rate"), F.round(called, 6).alias("called"), F.round(F.avg("p"), 6).alias("mean_p"), F.max("p").alias("max_p"))


def masked(frame: DataFrame, columns: list[str], share: float, key: str = "id", seed: int = 42) -> DataFrame:
    """``frame`` with about ``share`` of the cells of ``columns`` null, chosen by a hash of row key and column name."""
    cell = lambda c: F.conv(F.substring(hash_order(F.col(key), F.lit(c), seed=seed), 1, 8), 16, 10).cast("long") % 1_000_000
    return frame.select(*[F.when(cell(c) >= int(share * 1_000_000), F.col(c)).alias(c) if c in columns else F.col(c) for c in frame.columns])


def subgroups(scored: DataFrame, replicates: int = 5, size: int = 5000, key: str = "id") -> DataFrame:
    """Confusion and rates of ``replicates`` subsets of at most ``size`` rows each, drawn by hash order (a sampling operator)."""
    out = None
    for r in range(replicates):
        ranked = hash_ranked(scored.withColumn("_h", hash_order(F.col(key), seed=r)), "_h").where(F.col("rank") <= size)
        one = ranked.agg(F.lit(r).alias("replicate"), F.count("*").alias("n"), *_cells(F.col("p") >= 0.5))
        out = one if out is None else out.unionByName(one)
    return rates(out)


def class_report(predicted: DataFrame, truth: str = "truth", said: str = "pred") -> DataFrame:
    """Per class: support, precision, recall, F1. Pairs of classes are counted first; all else works on those counts."""
    cells = predicted.groupBy(truth, said).agg(F.count("*").alias("n"))
    hit = F.when(F.col(truth) == F.col(said), F.col("n")).otherwise(0)
    per_truth = cells.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    per_said = cells.groupBy(F.col(said).alias("class")).agg(F.sum("n").alias("called"))
    both = per_truth.join(per_said, "class", "full_outer").select("class", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "called", "tp")])
    return both.select("*", _ratio(F.col("tp"), F.col("called")).alias("precision"), _ratio(F.col("tp"), F.col("support")).alias("recall"), _ratio(2 * F.col("tp"), F.col("called") + F.col("support")).alias("f1"))


def class_summary(report: DataFrame) -> DataFrame:
    """One row: accuracy, macro F1 and F1 weighted by support, from a class report."""
    return report.agg(
        F.sum("support").alias("n"), F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"), F.round(F.avg("f1"), 5).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 5).alias("weighted_f1")
    )


def top_k(candidates: DataFrame, k: int, key: str = "id", label: str = "label", score: str = "score") -> DataFrame:
    """``key`` and the ``k`` best labels in order (ties: the smaller label), for candidates in rows."""
    ranked = rank_within(candidates.select(key, label, score), [key], [F.desc(score), F.col(label)]).where(F.col("rank") <= k)  # kept before the shuffle
    best_k = F.sort_array(F.collect_list(F.struct("rank", F.col(label).alias("label"))))
    return ranked.groupBy(key).agg(F.transform(best_k, lambda x: x["label"]).alias("top"))


def with_group_size(rows: DataFrame, keys: tuple[str, ...], name: str = "group_size") -> DataFrame:
    """``rows`` with how many of them agree in ``keys``, also where one group has most of them."""
    return joined_back(rows, rows.groupBy(*keys).agg(F.count("*").alias(name)), keys, name)


def rank_within(frame: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Row numbers within groups that are small by nature (a row's candidates, an entity's records)."""
    return frame.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
