"""Queries that judge scores and predictions, and splits of rows for that."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import cleaning, evaluation, splits, temporal
from tidemark.plans.longitudinal import _ACUTE, _LAB, _SNAP, _acute, _points, _with
from tidemark.sources import roles
from tidemark.sources.readers import table
from tidemark.sources.roles import SQL


def confusion_at_t(spark, sf):
    return evaluation.confusion(roles.scored(spark, sf), 0.5, ("grp",))


def threshold_sweep(spark, sf):
    return evaluation.sweep(roles.scored(spark, sf))


def best_threshold(spark, sf):
    return evaluation.best(evaluation.sweep(roles.scored(spark, sf)))


def roc_auc(spark, sf):
    return evaluation.areas(roles.scored(spark, sf)).select("n_pos", "n_neg", "roc_auc")


def avg_precision(spark, sf):
    return evaluation.areas(roles.scored(spark, sf)).select("n_pos", "avg_precision")


def brier(spark, sf):
    return evaluation.brier(roles.scored(spark, sf))


def calibration_qcut(spark, sf):
    return evaluation.calibration(roles.scored(spark, sf))


def probability_summary(spark, sf):
    return cleaning.described(roles.scored(spark, sf), "p")


def sparse_history(spark, sf):
    sized = roles.scored(spark, sf).withColumn("words", F.floor(F.col("size") / 100).cast("int") + 1)
    return evaluation.by_size(sized, F.col("words"))


def sparse_groups(spark, sf):
    """Rates by how many rows a source has in its language, each count joined back to its rows."""
    sized = evaluation.with_group_size(roles.scored(spark, sf), ("entity", "grp"), "n_rows")
    return evaluation.by_size(sized, F.col("n_rows"))


def patient_level(spark, sf):
    return evaluation.by_entity(roles.scored(spark, sf))


def missingness_stress(spark, sf):
    """How many cells are lost, and what recall is left, when 5, 10 and 20 % of scores are missing (a missing score is no call)."""
    out = None
    for share in (0.05, 0.10, 0.20):
        cut = evaluation.masked(roles.scored(spark, sf), ["p"], share)
        one = cut.agg(F.lit(share).alias("share"), F.count(F.when(F.col("p").isNull(), 1)).alias("lost"), F.count(F.when((F.col("label") == 1) & (F.col("p") >= 0.5), 1)).alias("tp"))
        out = one if out is None else out.unionByName(one)
    return out


def random_subgroups(spark, sf):
    return evaluation.subgroups(roles.scored(spark, sf), 5, 200)


def _predicted(spark, sf):
    lines = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("truth"), F.floor(F.col("o_totalprice")).cast("long").alias("t"))
    classes = F.array(*[F.lit(c) for c in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    return lines.select(F.col("o_orderkey").alias("id"), "truth", F.element_at(classes, (F.col("t") % 5 + 1).cast("int")).alias("pred"), "t", classes.alias("classes"))


def multiclass_report(spark, sf):
    return evaluation.class_report(_predicted(spark, sf))


def multiclass_summary(spark, sf):
    return evaluation.class_summary(evaluation.class_report(_predicted(spark, sf)))


def confusion_matrix(spark, sf):
    return _predicted(spark, sf).groupBy("truth", "pred").agg(F.count("*").alias("n"))


def topk_accuracy(spark, sf):
    wide = _predicted(spark, sf).select("id", "truth", "t", F.posexplode("classes").alias("i", "label"))
    candidates = wide.select("id", "truth", "label", ((F.col("t") * (F.col("i") + 7)) % 101).cast("double").alias("score"))
    top = evaluation.top_k(candidates, 3)
    joined = top.join(_predicted(spark, sf).select("id", "truth"), "id")
    hit = lambda k: F.avg(F.array_contains(F.slice("top", 1, k), F.col("truth")).cast("int"))
    return joined.agg(F.count("*").alias("n"), F.round(hit(1), 6).alias("top1"), F.round(hit(3), 6).alias("top3"))


def split_grouped(spark, sf):
    labelled = temporal.forward_labels(_points(spark, sf), _acute(spark, sf)).select("entity", "label")
    return splits.grouped(labelled)


def split_leakage(spark, sf):
    """Rows of entities in both splits: must be none."""
    halves = split_grouped(spark, sf)
    return splits.overlap(halves.select("entity", "split"), "entity")


_CELLS = "count(*) FILTER (NOT said AND label <> 1) AS tn, count(*) FILTER (said AND label <> 1) AS fp, count(*) FILTER (NOT said AND label = 1) AS fn, count(*) FILTER (said AND label = 1) AS tp"
_RATES = """round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE round(tp / (tp + fn), 6) END AS recall,
    CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE round(2 * tp / (2 * tp + fp + fn), 6) END AS f1, CASE WHEN tn + fp = 0 THEN NULL ELSE round(tn / (tn + fp), 6) END AS specificity, CASE WHEN tn + fn = 0 THEN 0 ELSE round(tn / (tn + fn), 6) END AS npv"""
_SWEEP = f"WITH {SQL['scored']}, c AS (SELECT t AS threshold, {_CELLS} FROM (SELECT t::DOUBLE AS t, label, p >= t::DOUBLE AS said FROM scored, (VALUES {', '.join(f'({t})' for t in evaluation.THRESHOLDS)}) v(t)) GROUP BY t), s AS (SELECT threshold, tn, fp, fn, tp, {_RATES} FROM c)"
_CUM = f"WITH {SQL['scored']}, g AS (SELECT p, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM scored GROUP BY p), c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(neg) OVER (ORDER BY p DESC) AS cn FROM g)"
_PRED = "WITH classes AS (SELECT ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'] AS c), pr AS (SELECT o_orderkey AS id, o_orderpriority AS truth, floor(o_totalprice)::BIGINT AS t, c[(floor(o_totalprice)::BIGINT % 5 + 1)] AS pred FROM orders, classes)"
_REPORT = """, a AS (SELECT truth AS class, count(*) AS support, count(*) FILTER (truth = pred) AS tp FROM pr GROUP BY truth), b AS (SELECT pred AS class, count(*) AS called FROM pr GROUP BY pred),
    m AS (SELECT class, coalesce(support, 0) AS support, coalesce(called, 0) AS called, coalesce(tp, 0) AS tp FROM a FULL JOIN b USING (class)),
    r AS (SELECT *, CASE WHEN called = 0 THEN 0 ELSE round(tp / called, 6) END AS precision, CASE WHEN support = 0 THEN 0 ELSE round(tp / support, 6) END AS recall, CASE WHEN called + support = 0 THEN 0 ELSE round(2 * tp / (called + support), 6) END AS f1 FROM m)"""
_GROUPED = _with("obs", "enc", _SNAP, _ACUTE, _LAB)[:-1] + """, st AS (SELECT entity, max(label) AS stratum, md5(entity || '|42') AS h FROM lab GROUP BY entity),
    rk AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h) AS i, round(count(*) OVER (PARTITION BY stratum) * 0.2) AS take FROM st), sp AS (SELECT entity, stratum, CASE WHEN i <= take THEN 'test' ELSE 'train' END AS split FROM rk)"""

QUERIES = {
    f.__name__: f
    for f in (
        confusion_at_t, threshold_sweep, best_threshold, roc_auc, avg_precision, brier, calibration_qcut, probability_summary, sparse_history, sparse_groups, patient_level, missingness_stress, random_subgroups,
        multiclass_report, multiclass_summary, confusion_matrix, topk_accuracy, split_grouped, split_leakage,
    )
}
ORACLES = {
    "confusion_at_t": f"WITH {SQL['scored']}, c AS (SELECT grp, {_CELLS} FROM (SELECT *, p >= 0.5 AS said FROM scored) GROUP BY grp) SELECT grp, tn, fp, fn, tp, {_RATES} FROM c",
    "threshold_sweep": _SWEEP + " SELECT * FROM s",
    "best_threshold": _SWEEP + " SELECT * FROM s ORDER BY f1 DESC, recall DESC, threshold LIMIT 1",
    "roc_auc": _CUM + " SELECT sum(pos) AS n_pos, sum(neg) AS n_neg, round(sum(neg * (cp - pos) + 0.5 * neg * pos) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM c",
    "avg_precision": _CUM + " SELECT sum(pos) AS n_pos, round(sum(pos * cp / (cp + cn)) / sum(pos), 6) AS avg_precision FROM c",
    "brier": f"WITH {SQL['scored']} SELECT count(*) AS n, round(avg((p - label) * (p - label)), 6) AS brier, round(avg(p), 6) AS mean_p, round(avg(label), 6) AS base_rate FROM scored",
    "calibration_qcut": f"""WITH {SQL['scored']}, e AS (SELECT list_distinct(quantile_cont(p, [{', '.join(f'{i / 10}' for i in range(11))}])) AS edges FROM scored),
        b AS (SELECT s.*, greatest(len(list_filter(edges, lambda x: x < p)), 1) AS bin FROM scored s, e),
        r AS (SELECT bin, count(*) AS n, min(p) AS least, max(p) AS most, round(avg(p), 6) AS mean_p, round(avg(label), 6) AS rate FROM b GROUP BY bin) SELECT *, round(abs(mean_p - rate), 5) AS gap FROM r""",
    "probability_summary": f"WITH {SQL['scored']} SELECT count(p) AS n, round(avg(p), 4) AS mean, round(stddev_samp(p), 4) AS std, min(p) AS least, max(p) AS most, round(quantile_cont(p, 0.25), 4) AS p25, round(quantile_cont(p, 0.5), 4) AS p50, round(quantile_cont(p, 0.75), 4) AS p75 FROM scored",
    "sparse_history": f"""WITH {SQL['scored']}, w AS (SELECT *, p >= 0.5 AS said, CASE WHEN size // 100 + 1 <= 1 THEN '1' WHEN size // 100 + 1 <= 3 THEN '2-3' WHEN size // 100 + 1 <= 10 THEN '4-10' ELSE '>10' END AS size_class FROM scored),
        g AS (SELECT size_class, count(*) AS n, {_CELLS} FROM w GROUP BY size_class), f AS (SELECT size_class, coalesce(n, 0) AS n, coalesce(tn, 0) AS tn, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(tp, 0) AS tp FROM (VALUES ('1'), ('2-3'), ('4-10'), ('>10')) v(size_class) LEFT JOIN g USING (size_class))
        SELECT size_class, n, tn, fp, fn, tp, CASE WHEN n = 0 THEN 0 ELSE round((tp + tn) / n, 6) END AS accuracy, {_RATES[_RATES.index('CASE'):]} FROM f""",
    "sparse_groups": f"""WITH {SQL['scored']}, w AS (SELECT *, p >= 0.5 AS said, count(*) OVER (PARTITION BY entity, grp) AS k FROM scored), s AS (SELECT *, CASE WHEN k <= 1 THEN '1' WHEN k <= 3 THEN '2-3' WHEN k <= 10 THEN '4-10' ELSE '>10' END AS size_class FROM w),
        g AS (SELECT size_class, count(*) AS n, {_CELLS} FROM s GROUP BY size_class), f AS (SELECT size_class, coalesce(n, 0) AS n, coalesce(tn, 0) AS tn, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(tp, 0) AS tp FROM (VALUES ('1'), ('2-3'), ('4-10'), ('>10')) v(size_class) LEFT JOIN g USING (size_class))
        SELECT size_class, n, tn, fp, fn, tp, CASE WHEN n = 0 THEN 0 ELSE round((tp + tn) / n, 6) END AS accuracy, {_RATES[_RATES.index('CASE'):]} FROM f""",
    "patient_level": f"WITH {SQL['scored']} SELECT entity, count(*) AS n, round(avg(label), 6) AS rate, round(avg(CAST(p >= 0.5 AS INT)), 6) AS called, round(avg(p), 6) AS mean_p, max(p) AS max_p FROM scored GROUP BY entity",
    "missingness_stress": f"""WITH {SQL['scored']}, m AS (SELECT s.t::DOUBLE AS share, label, CASE WHEN CAST('0x' || substr(md5(id || '|p|42'), 1, 8) AS BIGINT) % 1000000 >= CAST(floor(s.t * 1000000) AS BIGINT) THEN p END AS p FROM scored, (VALUES (0.05), (0.10), (0.20)) s(t))
        SELECT share, count(*) FILTER (p IS NULL) AS lost, count(*) FILTER (label = 1 AND p >= 0.5) AS tp FROM m GROUP BY share""",
    "random_subgroups": f"WITH {SQL['scored']}, r AS (SELECT rep AS replicate, label, p >= 0.5 AS said, row_number() OVER (PARTITION BY rep ORDER BY md5(id || '|' || rep)) AS i FROM scored, range(5) x(rep)), c AS (SELECT replicate, count(*) AS n, {_CELLS} FROM r WHERE i <= 200 GROUP BY replicate) SELECT replicate, n, tn, fp, fn, tp, {_RATES} FROM c",
    "multiclass_report": _PRED + _REPORT + " SELECT * FROM r",
    "multiclass_summary": _PRED + _REPORT + " SELECT sum(support) AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 5) AS macro_f1, round(sum(f1 * support) / sum(support), 5) AS weighted_f1 FROM r",
    "confusion_matrix": _PRED + " SELECT truth, pred, count(*) AS n FROM pr GROUP BY 1, 2",
    "topk_accuracy": _PRED + """, s AS (SELECT id, truth, c[i + 1] AS label, (t * (i + 7)) % 101 AS score FROM pr, classes, range(5) x(i)), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS n FROM s)
        SELECT (SELECT count(*) FROM pr) AS n, round(count(*) FILTER (n = 1 AND label = truth) / (SELECT count(*) FROM pr), 6) AS top1, round(count(*) FILTER (n <= 3 AND label = truth) / (SELECT count(*) FROM pr), 6) AS top3 FROM k""",
    "split_grouped": _GROUPED + " SELECT entity, stratum, split FROM sp",
    "split_leakage": _GROUPED + " SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared FROM sp a JOIN sp b ON a.entity = b.entity AND a.split < b.split GROUP BY 1, 2",
}
