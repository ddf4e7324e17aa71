"""Which question to ask next: what a question is about, what speaks for it and against it, and when there is enough to go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import normalised, tokens
from tidemark.operators.cases import TIE, both_ways, once_a_state
from tidemark.operators.evaluation import rank_within

#: Words without content in questions, and words that tell what a question is about.
STOP = (
    "a", "an", "the", "do", "does", "did", "you", "your", "have", "has", "had", "are", "is", "was", "were", "be", "been", "to", "of", "in", "on", "at", "for", "with", "without", "and", "or", "but",
    "that", "this", "these", "those", "any", "some", "ever", "recently", "currently", "feel", "feeling", "experiencing", "related", "reason", "consulting",
)
GENERIC = ("somewhere", "related", "reason", "consulting", "general", "overall", "anything", "something")
RISK = ("smoke", "smoking", "cigarette", "alcohol", "drink", "drugs", "daycare", "contact", "exposure", "live", "work", "occupation")
DETAIL = ("colored", "colour", "abundant", "intense", "worse", "increased", "improves", "improved", "rest", "exertion", "breath", "cough", "sputum", "mucus", "pain", "severity", "duration", "night", "morning", "radiate")
#: Weights of a question's score, and what is taken off.
WEIGHTS = {"association": 0.24, "conditional": 0.20, "jaccard": 0.08, "multi_support": 0.12, "novelty": 0.10, "specificity": 0.10, "role": 0.08, "balance": 0.04, "relevance": 0.04}
PENALTIES = {"generic": 0.16, "antecedent": 0.18, "value": 0.20, "redundancy": 0.25, "low_information": 0.08}
#: Positive codes that are needed before anything is concluded.
LEAST_POSITIVE = 2


def content(text: Column) -> Column:
    """Distinct words with content of a question or a name."""
    return F.array_distinct(F.filter(tokens(normalised(text)), lambda w: ~w.isin(*STOP) & (F.length(w) > 2)))


def described(ontology: DataFrame) -> DataFrame:
    """``ontology`` (``code, name, question, data_type, values, antecedent``; a dimension) with ``role, q_words, name_words``."""
    said = tokens(normalised(F.coalesce("question", F.lit(""))))
    says = lambda words: F.arrays_overlap(said, F.array(*[F.lit(w) for w in words]))
    role = (
        F.when((F.coalesce("data_type", F.lit("")) != "B") & (F.coalesce(F.size("values"), F.lit(0)) > 0), "value")
        .when(says(GENERIC), "generic")
        .when(F.coalesce("antecedent", F.lit(False)), F.when(says(RISK), "risk").otherwise("history"))
        .when(says(RISK), "risk")
        .when(says(DETAIL), "symptom_detail")
        .otherwise("symptom")
    )
    return ontology.select("code", "question", role.alias("role"), content(F.coalesce("question", F.lit(""))).alias("q_words"), content(F.coalesce("name", F.lit(""))).alias("name_words"))


def role_score(role: Column, positives: Column) -> Column:
    """How welcome a question of a role is, given how many codes are known to hold."""
    risk = F.when(positives >= 3, 0.78).when(positives == 2, 0.58).otherwise(0.42)
    history = F.when(positives >= 3, 0.85).otherwise(0.62)
    return F.when(role == "symptom", 1.0).when(role == "symptom_detail", 0.95).when(role == "history", history).when(role == "risk", risk).when(role == "value", 0.55).otherwise(0.35)


def balance(conditional: Column) -> Column:
    """How much a question tells apart: neither what nearly never nor what nearly always holds."""
    return F.when(conditional <= 0, 0.0).when(conditional < 0.05, 0.20).when(conditional < 0.15, 0.55).when(conditional < 0.75, 1.0).when(conditional < 0.95, 0.80).otherwise(0.55)


def ranked(known: DataFrame, graph: DataFrame, ontology: DataFrame, asked: DataFrame | None = None, k: int = 5, least_association: float = 0.03, least_pairs: int = 10) -> DataFrame:
    """Per ``conv`` the ``k`` best codes to ask for: ``conv, candidate, role, support, score, rank`` and the parts of the score.

    ``known``: ``conv, code, positive``; ``asked``: ``conv, code``. Neighbours of positive codes that are neither known nor
    asked are scored by nine weighted parts and five penalties, with a bonus for each further support, and less for history
    and risk while questions about symptoms are left. Values of a code are asked for only if the code is known. Positive
    codes of a conversation are few; their words are compared with those of each candidate. Conversations in the same state
    are ranked once; the graph, of the size of the coding system's pairs, is sent to where they are.
    """
    return once_a_state(known, lambda some, done: _ranked(some, graph, ontology, done, k, least_association, least_pairs), asked)


def _ranked(known: DataFrame, graph: DataFrame, ontology: DataFrame, asked: DataFrame | None, k: int, least_association: float, least_pairs: int) -> DataFrame:
    items = described(ontology).where("trim(coalesce(question, '')) <> ''")
    near = both_ways(graph).where((F.col("association") >= least_association) & (F.col("pair_count") >= least_pairs))
    positive = known.where("positive").select("conv", "code").distinct()
    words = positive.join(F.broadcast(described(ontology)), "code", "left")
    held = words.groupBy("conv").agg(F.count("*").alias("_n"), F.collect_list(F.struct("name_words", "q_words")).alias("_held"))
    found = positive.join(F.broadcast(near), F.col("code") == F.col("a")).groupBy("conv", F.col("b").alias("candidate")).agg(
        F.count("*").alias("support"), F.avg("association").alias("association"), F.avg("conditional").alias("conditional"), F.avg("jaccard").alias("jaccard"), F.sum("pair_count").alias("pairs")
    )
    done = known.select("conv", F.col("code").alias("candidate"))
    if asked is not None:
        done = done.unionByName(asked.select("conv", F.col("code").alias("candidate")))
    fresh = found.join(done.distinct(), ["conv", "candidate"], "left_anti")
    parents = known.select("conv", F.col("code").alias("_parent")).distinct()
    values = fresh.where(F.col("candidate").contains("_@_")).withColumn("_parent", F.substring_index("candidate", "_@_", 1)).join(parents, ["conv", "_parent"], "left_semi").drop("_parent")
    fresh = fresh.where(~F.col("candidate").contains("_@_")).unionByName(values)
    met = fresh.join(F.broadcast(items.withColumnRenamed("code", "candidate")), "candidate").join(held, "conv")

    shared = lambda x, y: F.size(F.array_intersect(x, y))
    both = lambda x, y: F.coalesce(F.try_divide(shared(x, y), F.least(F.size(x), F.size(y))), F.lit(0.0))
    over = lambda part: F.coalesce(F.array_max(F.transform("_held", part)), F.lit(0.0))
    relevance = over(lambda h: both(F.coalesce(h["name_words"], F.array().cast("array<string>")), F.col("q_words")))
    redundancy = over(lambda h: F.coalesce(F.try_divide(shared(F.col("q_words"), F.coalesce(h["q_words"], F.array().cast("array<string>"))), F.size("q_words")), F.lit(0.0)))
    n_words, is_generic = F.size("q_words"), F.col("role") == "generic"
    met = met.withColumns({"relevance": relevance, "redundancy": redundancy})
    parts = {
        "association": F.least(F.lit(1.0), "association"), "conditional": F.least(F.lit(1.0), "conditional"), "jaccard": F.least(F.lit(1.0), "jaccard"),
        "multi_support": F.least(F.lit(1.0), F.sqrt(F.col("support") / F.col("_n"))),
        "novelty": F.when(is_generic, 0.35).when(n_words == 0, 0.25).otherwise(F.greatest(F.lit(0.0), 1 - F.col("relevance"))),
        "specificity": F.when(n_words == 0, 0.0).when(is_generic, 0.20).otherwise(0.45 + 0.55 * F.least(F.lit(1.0), n_words / 7)),
        "role": role_score(F.col("role"), F.col("_n")), "balance": balance(F.col("conditional")), "relevance": F.col("relevance"),
    }
    against = {"generic": is_generic, "antecedent": F.col("role").isin("history", "risk"), "value": F.col("role") == "value", "low_information": n_words <= 2}
    score = sum((parts[p] * w for p, w in WEIGHTS.items()), F.lit(0.0)) - PENALTIES["redundancy"] * F.col("redundancy")
    score = score - sum((F.when(c, PENALTIES[p]).otherwise(0.0) for p, c in against.items()), F.lit(0.0))
    symptoms_left = F.max(F.col("role").isin("symptom", "symptom_detail")).over(W.partitionBy("conv"))
    score = score + F.when(F.col("support") >= 2, F.least(F.lit(0.10), 0.04 * (F.col("support") - 1))).otherwise(0.0) - F.when(symptoms_left & against["antecedent"], 0.10).otherwise(0.0)
    scored = met.select("conv", "candidate", "role", "support", "conditional", "association", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) + TIE, 5).alias("score"))
    order = [F.desc("score"), F.desc("support"), F.desc(F.round("conditional", 6)), F.desc(F.round("association", 6)), F.col("candidate")]
    return rank_within(scored, ["conv"], order).where(F.col("rank") <= k).select("conv", "candidate", "role", "support", "score", "rank")


def sufficient(known: DataFrame, least: int = LEAST_POSITIVE) -> DataFrame:
    """``conv, n_positive, enough, reason``: whether the positive codes of a conversation are enough to conclude from."""
    rolled = known.groupBy("conv").agg(F.count_distinct(F.when(F.col("positive"), F.col("code"))).alias("n_positive"))
    reason = F.when(F.col("n_positive") == 0, "no_positive_evidence").when(F.col("n_positive") >= least, "multiple_supported_evidence").otherwise("single_evidence_insufficient_by_policy")
    return rolled.select("conv", "n_positive", (F.col("n_positive") >= least).alias("enough"), reason.alias("reason"))


def near_misses(candidates: DataFrame, ontology: DataFrame, declined: DataFrame | None = None, k: int = 3, least_score: float = 0.55, least_coverage: float = 0.67) -> DataFrame:
    """``id, code, question, rank``: the ``k`` best codes that a text nearly says, each once, without those declined (``id, code``)."""
    near = candidates.where((F.col("score") >= least_score) & (F.col("coverage") >= least_coverage)).groupBy("id", "code").agg(F.max("score").alias("score"))
    if declined is not None:
        near = near.join(declined.select("id", "code"), ["id", "code"], "left_anti")
    asked = near.join(F.broadcast(ontology.select("code", "question").where("trim(coalesce(question, '')) <> ''")), "code")
    return rank_within(asked, ["id"], [F.desc("score"), F.col("code")]).where(F.col("rank") <= k).select("id", "code", "question", "rank")
