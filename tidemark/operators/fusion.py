"""Rules over several sources: signals, sufficiency, safety, urgency and ranked recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.evaluation import rank_within

#: Protocols with their scores, the one for entities that nothing else is found for, and points of severities.
PROTOCOLS = (
    ("Glycemic Dysregulation & Metabolic Management", 0.88),
    ("Hypertension & Cardiovascular Risk Management", 0.82),
    ("Renal Function Monitoring & Nephroprotection", 0.78),
    ("Metabolic & Weight Management Protocol", 0.72),
)
PREVENTIVE = ("Preventive Health & Longitudinal Surveillance", 0.75)
SEVERITY_POINTS = {"HIGH": 1.0, "MODERATE": 0.6, "MILD": 0.3, "UNKNOWN": 0.2, "NORMAL": 0.0}
#: Weights of a recommendation's score.
WEIGHTS = {"probability": 0.35, "relevance": 0.20, "trend": 0.15, "risk": 0.15, "safety": -0.15, "sufficiency": -0.20}


def signals(latest: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``latest`` (``entity, kind, latest_value, trend``) with abnormality, severity and whether the trend is for the worse.

    ``thresholds`` (``kind, low, high, very_low, very_high, direction``) has one row for each kind.
    """
    joined = latest.join(thresholds, "kind", "left")
    v = F.col("latest_value")
    abnormality = (
        F.when(v.isNull() | F.col("direction").isNull() | (F.col("low").isNull() & F.col("high").isNull()), "UNKNOWN").when(v < F.col("low"), "LOW").when(v > F.col("high"), "HIGH").otherwise("NORMAL")
    )
    severity = F.when(abnormality.isin("UNKNOWN", "NORMAL"), abnormality).when((abnormality == "HIGH") & (v >= F.col("very_high")), "HIGH").when((abnormality == "LOW") & (v <= F.col("very_low")), "HIGH").otherwise("MILD")
    worse = ((F.col("direction") == "higher") & (F.col("trend") == "INCREASING")) | ((F.col("direction") == "lower") & (F.col("trend") == "DECREASING"))
    return joined.select("entity", "kind", "latest_value", "trend", abnormality.alias("abnormality"), severity.alias("severity"), F.coalesce(worse, F.lit(False)).alias("worsening"))


def sufficiency(confidence: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per entity of either side: 0.6 of its history's confidence and 0.4 of its evidence (full at 5, 0.3 under 2), with a band.

    The band is that of the score as it is; what is returned is the score rounded to three places.
    """
    both = confidence.select("entity", F.col("score").alias("_c")).join(evidence.select("entity", "n_evidence"), "entity", "full_outer")
    share = F.when(F.col("n_evidence").isNull(), 0.0).when(F.col("n_evidence") < 2, 0.3).otherwise(F.least(F.lit(1.0), F.col("n_evidence") / 5.0))
    score = 0.6 * F.coalesce("_c", F.lit(0.0)) + 0.4 * share
    band = F.when(score >= 0.70, "HIGH").when(score >= 0.40, "MODERATE").otherwise("LIMITED")
    return both.select("entity", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.round(score.cast("decimal(18, 9)"), 3).cast("double").alias("sufficiency"), band.alias("band"))


def safety(signal_rows: DataFrame, groups: dict[str, tuple[str, ...]], bands: DataFrame) -> DataFrame:
    """Per entity and safety group: whether any of its kinds was measured, which of them are abnormal, and whether data are few.

    ``bands`` (``entity, band``) comes from ``sufficiency``; ``limited`` says that its band is LIMITED, in which case no group
    that is not flagged is to be relied on. Entities without signals have no rows.
    """
    table = F.array(*[F.struct(F.lit(g).alias("grp"), F.array(*[F.lit(k) for k in ks]).alias("kinds")) for g, ks in groups.items()])
    rolled = signal_rows.groupBy("entity").agg(F.collect_set("kind").alias("seen"), F.collect_set(F.when(F.col("abnormality").isin("LOW", "HIGH"), F.col("kind"))).alias("bad"))
    limited = bands.groupBy("entity").agg(F.max(F.col("band") == "LIMITED").alias("limited"))
    each = rolled.join(limited, "entity", "left").select("entity", "seen", "bad", "limited", F.explode(table).alias("g"))
    concern = F.sort_array(F.array_intersect("bad", "g.kinds"))
    return each.select(
        "entity", F.col("g.grp").alias("grp"), F.arrays_overlap("seen", "g.kinds").alias("performed"), (F.size(concern) > 0).alias("flagged"), F.concat_ws(",", concern).alias("concerns"), F.coalesce("limited", F.lit(False)).alias("limited")
    )


def urgency(context: DataFrame, conditions: DataFrame, red_flags: tuple[str, ...], keywords: tuple[str, ...], emergencies: tuple[str, ...] = (), most: int = 5) -> DataFrame:
    """Per entity of ``context`` how urgent its findings are, and why: ``entity, urgency, reasons``.

    ``context``: ``entity, risk, sufficiency_band, evidence`` (the text of what was affirmed, null for none). ``conditions``:
    ``entity, condition, probability``, of which the ``most`` likeliest count (of equal ones the smaller name). A red-flag
    condition of 0.25 or more, or an emergency of 0.60 or more, is URGENT_EVALUATION. Short of that, a red-flag phrase in
    the evidence or a risk of 0.50 is HIGH_PRIORITY, anything else ROUTINE_FOLLOW_UP. Without any condition LIMITED data are
    INSUFFICIENT_INFORMATION whatever else is known. Reasons come in that order; a risk from 0.30 on is one, too.
    """
    ranked = rank_within(conditions, ["entity"], [F.desc("probability"), F.col("condition")]).where(F.col("rank") <= most)
    band = F.when(F.col("probability") >= 0.60, "HIGH").when(F.col("probability") >= 0.25, "MEDIUM").otherwise("LOW")
    red = F.col("condition").isin(*red_flags) & (band != "LOW") if red_flags else F.lit(False)
    emergency = F.col("condition").isin(*emergencies) & (band == "HIGH") if emergencies else F.lit(False)
    reason = F.when(red, F.struct("rank", F.concat(F.lit("condition: "), "condition", F.lit(" ("), band, F.lit(")")).alias("text")))
    found = ranked.groupBy("entity").agg(F.max(red | emergency).alias("_urgent"), F.sort_array(F.collect_list(reason))["text"].alias("_red"))
    text = F.lower(F.coalesce("evidence", F.lit("")))
    phrases = F.filter(F.array(*[F.when(text.contains(k), F.lit(f"phrase: {k}")) for k in keywords]), lambda x: x.isNotNull()) if keywords else F.array().cast("array<string>")
    risk = F.when(F.col("risk") >= 0.50, "risk: high").when(F.col("risk") >= 0.30, "risk: elevated")
    joined = context.join(found, "entity", "left")
    few = (F.col("sufficiency_band") == "LIMITED") & F.col("_urgent").isNull()
    level = F.when(few, "INSUFFICIENT_INFORMATION").when(F.col("_urgent"), "URGENT_EVALUATION").when((F.size(phrases) > 0) | (F.coalesce("risk", F.lit(0.0)) >= 0.50), "HIGH_PRIORITY").otherwise("ROUTINE_FOLLOW_UP")
    reasons = F.array_compact(F.concat(F.coalesce("_red", F.array().cast("array<string>")), phrases, F.array(risk), F.array(F.when(few, "data: limited"))))
    return joined.select("entity", level.alias("urgency"), reasons.alias("reasons"))


def recommendations(candidates: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best of each entity's candidates, by the weighted score of their parts, with the parts kept.

    ``candidates``: ``entity, name, probability, relevance, trend, risk, safety, sufficiency``, each part in 0..1 or null
    (zero). Of names of an entity that are equal in lower case the best one counts.
    """
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = sum((part(c) * w for c, w in WEIGHTS.items() if c != "sufficiency"), F.lit(0.0)) + WEIGHTS["sufficiency"] * (1 - part("sufficiency"))
    scored = candidates.select("entity", "name", *WEIGHTS, F.round(score + 3.7e-8, 4).alias("score"))
    best = scored.groupBy("entity", F.lower("name").alias("_n")).agg(F.max(F.struct("score", "name", *WEIGHTS)).alias("m")).select("entity", "m.*")
    return rank_within(best, ["entity"], [F.desc("score"), F.col("name")]).where(F.col("rank") <= k)


def relevance(signal_rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """``entity, name, relevance, trend``: how far the signals of an entity concern each profile.

    ``profiles`` (``name, kinds``) is a dimension. Relevance is the share of a profile's kinds that are abnormal; trend the
    points of those that get worse (by severity) against the number of kinds, at most 1. Entities without a signal of a
    profile have no row for it.
    """
    points = F.lit(0.2)
    for severity, p in SEVERITY_POINTS.items():
        points = F.when(F.col("severity") == severity, p).otherwise(points)
    kinds = profiles.select("name", F.size(F.array_distinct("kinds")).alias("_n"), F.explode(F.array_distinct("kinds")).alias("kind"))
    met = signal_rows.join(kinds, "kind").groupBy("entity", "name").agg(
        F.first("_n").alias("_n"), F.count_distinct(F.when(F.col("abnormality").isin("LOW", "HIGH"), F.col("kind"))).alias("_abnormal"), F.sum(F.when(F.col("worsening"), points).otherwise(0.0)).alias("_points")
    )
    return met.select("entity", "name", F.round(F.col("_abnormal") / F.col("_n"), 6).alias("relevance"), F.round(F.least(F.lit(1.0), F.col("_points") / F.col("_n")), 6).alias("trend"))


def biomarker_protocols(signal_rows: DataFrame, risks: DataFrame) -> DataFrame:
    """``entity, name, score``: up to five protocols that an entity's signals and risk ask for.

    ``signal_rows``: ``entity, kind, abnormality``; ``risks``: ``entity, risk, band``, a null risk for one not assessed.
    Kinds are told by parts of their names. One pass: the signals of an entity are reduced to flags.
    """
    kind = F.lower("kind")
    holds = lambda *parts: F.array_contains(F.array(*[kind.contains(p) for p in parts]), True)
    any_of = lambda c, name: F.max(F.coalesce(c, F.lit(False))).alias(name)
    a1c = holds("hemoglobin a1c", "hba1c")
    flags = signal_rows.groupBy("entity").agg(
        any_of((a1c & F.col("abnormality").isin("HIGH", "MILD", "NORMAL")) | (holds("fasting glucose", "glucose") & ~a1c & F.col("abnormality").isin("HIGH", "MILD")), "glycemic"),
        any_of(holds("systolic", "diastolic"), "pressure"), any_of(holds("creatinine", "urea nitrogen", "bun"), "renal"), any_of(holds("body mass index", "bmi", "weight"), "weight"),
    )
    both = flags.join(risks.select("entity", "risk", "band"), "entity", "full_outer")
    rows = [(F.coalesce(flag, F.lit(False)), F.lit(name), score) for flag, (name, score) in zip((F.col("glycemic"), F.col("pressure"), F.col("renal"), F.col("weight")), PROTOCOLS, strict=True)]
    rows.append((F.col("risk").isNotNull(), F.concat(F.lit("90-Day Acute Risk Mitigation & Surveillance ("), F.coalesce("band", F.lit("LOW")), F.lit(" Risk)")), 0.80))
    each = F.filter(F.array(*[F.when(c, F.struct(n.alias("name"), F.lit(s).alias("score"))) for c, n, s in rows]), lambda x: x.isNotNull())
    return both.select("entity", F.explode(each).alias("p")).select("entity", "p.name", "p.score")


def merged_recommendations(entities: DataFrame, conditions: DataFrame, protocols: DataFrame) -> DataFrame:
    """``entity, name, score, origin, rank``: conditions, then the protocols that repeat none of them, then a default for entities with neither.

    A protocol repeats a condition whose name is a part of its own, without regard to case. Of equal scores conditions come
    first, then the smaller name.
    """
    c, p = conditions.alias("c"), protocols.alias("p")
    repeats = (F.col("p.entity") == F.col("c.entity")) & F.lower("p.name").contains(F.lower("c.name"))
    found = conditions.select("entity", "name", "score", F.lit("condition").alias("origin"))
    found = found.unionByName(p.join(c, repeats, "left_anti").select("entity", "name", "score", F.lit("protocol").alias("origin")))
    none = entities.select("entity").distinct().join(found, "entity", "left_anti").select("entity", F.lit(PREVENTIVE[0]).alias("name"), F.lit(PREVENTIVE[1]).alias("score"), F.lit("preventive").alias("origin"))
    return rank_within(found.unionByName(none), ["entity"], [F.desc("score"), F.col("origin"), F.col("name")])


def risk_band(p: Column, cuts: tuple[float, float, float] = (0.15, 0.30, 0.50)) -> Column:
    """LOW, MODERATE, HIGH or VERY_HIGH; the serving variant cuts at 0.20, 0.45 and 0.70."""
    return F.when(p < cuts[0], "LOW").when(p < cuts[1], "MODERATE").when(p < cuts[2], "HIGH").otherwise("VERY_HIGH")
