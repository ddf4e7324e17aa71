"""Bags of codes: validation, first-wins deduplication, vocabulary, encoding, class shares, co-occurrence and what to ask next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.splits import signature
from tidemark.session import stored

#: Tokens before all codes in a vocabulary.
SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]")

#: Spellings of each sex, whose numbers are their places.
SEXES = (("f", "female", "0"), ("m", "male", "1"), ("u", "unknown", "2"))

#: Added before scores are rounded, so that halves go the same way in whatever order the parts are summed.
TIE = 3.7e-8


def atom(text: Column) -> Column:
    """``code`` and ``value`` of an atom written ``CODE`` or ``CODE_@_VALUE``."""
    parts = F.split(F.trim(text), "_@_", 2)
    return F.struct(F.element_at(parts, 1).alias("code"), F.when(F.size(parts) > 1, F.element_at(parts, 2)).alias("value"))


def problems(cases: DataFrame, ontology: DataFrame) -> DataFrame:
    """``cases`` with ``problem``: why a case is not usable, or null.

    ``ontology`` (``code, kind, allowed``; kind B has no value, others one of ``allowed``) is a dimension whose size is that
    of the coding system; it travels as one map.
    """
    codes = ontology.agg(F.map_from_entries(F.collect_list(F.struct("code", F.struct("kind", "allowed")))).alias("_codes"))
    joined = cases.join(F.broadcast(codes))
    unknown = F.exists("codes", lambda a: F.try_element_at(F.col("_codes"), atom(a)["code"]).isNull())

    def wrong(a: Column) -> Column:
        x, entry = atom(a), F.try_element_at(F.col("_codes"), atom(a)["code"])
        return F.when(entry["kind"] == "B", x["value"].isNotNull()).otherwise(~F.coalesce(F.array_contains(entry["allowed"], x["value"]), F.lit(False)))

    problem = (
        F.when(F.expr("try_cast(age AS double) IS NULL") | F.isnan(F.col("age").cast("double")) | (F.col("age") < 0), "age")
        .when(~F.upper(F.coalesce("sex", F.lit(""))).isin("F", "M", "U", "UNKNOWN"), "sex")
        .when(F.col("codes").isNull() | (F.size("codes") == 0), "no codes")
        .when(unknown, "unknown code")
        .when(F.exists("codes", wrong), "value")
    )
    return joined.select(*cases.columns, problem.alias("problem"))


def first_wins(cases: DataFrame, order: str = "case_id") -> DataFrame:
    """One case of each list of codes, the one that comes first; ``signature`` and how many ``copies`` there were.

    The first one is a minimum, not a window, so copies are merged before the shuffle, however many they are.
    """
    whole = F.struct(order, *[c for c in cases.columns if c != order])
    kept = cases.groupBy(signature(F.col("codes")).alias("signature")).agg(F.min(whole).alias("_c"), F.count("*").alias("copies"))
    return kept.select(*[F.col(f"_c.{c}").alias(c) for c in cases.columns], "signature", "copies")


def vocabulary(cases: DataFrame) -> DataFrame:
    """``token, token_id``: the special tokens, then all codes in order. One row for each code of the coding system."""
    from pyspark.sql import Window as W

    codes = cases.select(F.explode("codes").alias("token")).distinct()
    numbered = codes.select("token", (F.row_number().over(W.orderBy("token")) + len(SPECIALS) - 1).cast("int").alias("token_id"))
    special = cases.sparkSession.createDataFrame([(t, i) for i, t in enumerate(SPECIALS)], "token string, token_id int")
    return special.unionByName(numbered)


def encoded(cases: DataFrame, vocab: DataFrame, length: int) -> DataFrame:
    """``case_id, input_ids, attention_mask``: [CLS] ids [SEP], cut or padded to ``length``; unknown codes are [UNK]."""
    ids = vocab.agg(F.map_from_entries(F.collect_list(F.struct("token", "token_id"))).alias("_v"))  # a map of the vocabulary's size
    known = F.transform("codes", lambda c: F.coalesce(F.try_element_at(F.col("_v"), c), F.lit(1)))
    body = F.concat(F.array(F.lit(2)), F.slice(known, 1, length - 2), F.array(F.lit(3)))
    padded = F.concat(body, F.array_repeat(F.lit(0), length - F.size(body)))
    mask = F.transform(padded, lambda i: (i != 0).cast("int"))
    return cases.join(F.broadcast(ids)).select("case_id", padded.alias("input_ids"), mask.alias("attention_mask"))


def age_statistics(cases: DataFrame, split: str = "split") -> DataFrame:
    """``age_mean, age_std``: mean and population deviation of the training rows' ages alone; a deviation of 0 counts as 1."""
    one = cases.where(F.col(split) == "train").agg(F.avg("age").alias("age_mean"), F.stddev_pop("age").alias("age_std"))
    return one.select("age_mean", F.when(F.col("age_std") > 0, F.col("age_std")).otherwise(1.0).alias("age_std"))


def person(cases: DataFrame, statistics: DataFrame) -> DataFrame:
    """``case_id, age_z, sex_id``: ages standardised by the training statistics and sexes by number; nulls for what is not valid."""
    age, sex = F.col("age").try_cast("double"), F.lower(F.trim(F.coalesce(F.col("sex").cast("string"), F.lit(""))))
    number = F.lit(None).cast("int")
    for i, names in enumerate(SEXES):
        number = F.when(sex.isin(*names), i).otherwise(number)
    joined = cases.join(F.broadcast(statistics))
    return joined.select("case_id", F.when(age.between(0, 130), (age - F.col("age_mean")) / F.col("age_std")).alias("age_z"), number.alias("sex_id"))


def normalised_shares(shares: DataFrame, by: str, weight: str) -> DataFrame:
    """``shares`` with ``share``: a weight against the sum of its group's; groups without weight have nulls."""
    total = shares.groupBy(by).agg(F.sum(weight).alias("_total"))
    return shares.join(total, by).withColumn("share", F.round(F.try_divide(weight, "_total"), 6)).drop("_total")


def nodes(cases: DataFrame) -> DataFrame:
    """``code, frequency, prevalence``: cases that hold a code."""
    n = cases.agg(F.count("*").alias("_n"))
    counted = cases.select(F.explode(F.array_distinct("codes")).alias("code")).groupBy("code").agg(F.count("*").alias("frequency"))
    return counted.join(F.broadcast(n)).select("code", "frequency", F.round(F.col("frequency") / F.col("_n"), 6).alias("prevalence"))


def edges(cases: DataFrame) -> DataFrame:
    """``a, b`` (in order) and how their codes occur together: count, both conditionals, Jaccard, and their geometric mean.

    Pairs are made within a case and counted in each task before the shuffle, each code with itself as well, so cases are
    read once; a row for each pair of codes is left.
    """
    pair = F.filter(F.flatten(F.transform(F.array_distinct("codes"), lambda x: F.transform(F.array_distinct("codes"), lambda y: F.struct(x.alias("a"), y.alias("b"))))), lambda z: z["a"] <= z["b"])
    met = stored(cases.select(F.explode(pair).alias("z")).groupBy("z.a", "z.b").agg(F.count("*").alias("pair_count")))  # a code with itself: cases that have it
    counted, size = met.where("a < b"), met.where("a = b").select(F.col("a").alias("code"), F.col("pair_count").alias("frequency"))
    joined = counted.join(size.select(F.col("code").alias("a"), F.col("frequency").alias("_na")), "a").join(size.select(F.col("code").alias("b"), F.col("frequency").alias("_nb")), "b")
    n = F.col("pair_count")
    return joined.select(
        "a", "b", "pair_count",
        F.round(n / F.col("_na"), 6).alias("conditional"),
        F.round(n / F.col("_nb"), 6).alias("reverse"),
        F.round(n / (F.col("_na") + F.col("_nb") - n), 6).alias("jaccard"),
        F.round(F.sqrt(n * n / (F.col("_na") * F.col("_nb"))), 6).alias("association"),
    )


def both_ways(graph: DataFrame) -> DataFrame:
    """Edges in both directions."""
    back = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "pair_count", F.col("reverse").alias("conditional"), F.col("conditional").alias("reverse"), "jaccard", "association")
    return graph.unionByName(back)


def once_a_state(known: DataFrame, rank: Callable[[DataFrame, DataFrame | None], DataFrame], asked: DataFrame | None = None) -> DataFrame:
    """What ``rank(known, asked)`` says of each ``conv``, made once for all conversations in the same state.

    A state is what is known (``conv, code, positive``) and asked (``conv, code``); ``rank`` gives few rows for each conversation
    and depends on nothing else. The first conversation of each state stands for it, and its rows are joined back to the others.
    """
    said = known.select("conv", _said("code", F.when(F.col("positive"), 2).otherwise(1)).alias("said"))
    if asked is not None:
        said = said.unionByName(asked.select("conv", _said("code", F.lit(0)).alias("said")))
    states = said.where("conv is not null").groupBy("conv").agg(F.sort_array(F.collect_set("said")).alias("state"))
    return _once(stored(states), rank, asked is not None)


def _said(code: Column | str, how: Column) -> Column:
    """An entry of a state: how a code was said (2 positive, 1 not, 0 asked), and the code unless it is null."""
    return F.concat(how.cast("string"), F.coalesce(F.concat(F.lit("="), code), F.lit("")))


def _once(states: DataFrame, rank: Callable[[DataFrame, DataFrame | None], DataFrame], asks: bool) -> DataFrame:
    """``once_a_state`` of ``conv, state``, read twice; conversations travel with 128 bits of their state, not with all of it."""
    key = F.unhex(F.md5(F.to_json("state")))
    first = stored(states.groupBy(key.alias("_k"), "state").agg(F.min("conv").alias("conv")))
    # a state's entries stay in one task from here on, so what is grouped by conversation needs no other shuffle
    each = first.select("conv", "state").repartition("conv").select("conv", F.explode("state").alias("s"))
    each = each.select("conv", F.substring("s", 1, 1).cast("int").alias("said"), F.when(F.length("s") > 1, F.expr("substring(s, 3)")).alias("code"))
    out = rank(each.where("said > 0").select("conv", "code", (F.col("said") == 2).alias("positive")), each.where("said = 0").select("conv", "code") if asks else None)
    best = out.groupBy("conv").agg(F.collect_list(F.struct(*[c for c in out.columns if c != "conv"])).alias("_best"))
    best = first.select("conv", "_k").join(best, "conv").select("_k", "_best")
    return states.select("conv", key.alias("_k")).join(best, "_k").select("conv", F.explode("_best").alias("b")).select("conv", "b.*")


def questions(known: DataFrame, graph: DataFrame, k: int = 5, least_association: float = 0.03, least_pairs: int = 10) -> DataFrame:
    """Per ``conv``, the ``k`` best codes to ask for next, given ``known`` (``conv, code, positive``).

    Neighbours of the positive codes that are not yet known are scored by mean association and conditional, the best
    Jaccard, the share of positive codes that support them and a bonus for each further support, clamped to 0..1.
    Known codes, positive or negated, are never asked again. Conversations in the same state are ranked once; the graph, of
    the size of the coding system's pairs, is sent to where they are.
    """
    return once_a_state(known, lambda some, _: _questions(some, graph, k, least_association, least_pairs))


def questions_of_bags(bags: DataFrame, positive: Callable[[Column], Column], graph: DataFrame, k: int = 5, least_association: float = 0.03, least_pairs: int = 10) -> DataFrame:
    """``questions`` of cases (``case_id, codes``, distinct codes; written, as they are read twice) as conversations: a code is known to hold if ``positive``."""
    entries = F.sort_array(F.transform("codes", lambda c: _said(c, F.when(positive(c), 2).otherwise(1))))
    states = bags.where("case_id is not null and size(codes) > 0").select(F.col("case_id").alias("conv"), entries.alias("state"))
    return _once(states, lambda some, _: _questions(some, graph, k, least_association, least_pairs), False)


def _questions(known: DataFrame, graph: DataFrame, k: int, least_association: float, least_pairs: int) -> DataFrame:
    near = both_ways(graph).where((F.col("association") >= least_association) & (F.col("pair_count") >= least_pairs))
    # one row for each conversation with all its codes: candidates are held against them in place, not by a join
    held = known.where("conv is not null").groupBy("conv").agg(F.collect_set("code").alias("_known"), F.collect_set(F.when(F.col("positive"), F.struct("code"))).alias("_positive"))
    met = held.select("conv", "_known", F.size("_positive").alias("_n"), F.explode("_positive.code").alias("code")).join(F.broadcast(near), F.col("code") == F.col("a"))
    fresh = met.where(~F.array_contains("_known", F.col("b"))).groupBy("conv", F.col("b").alias("candidate")).agg(
        F.count("*").alias("support"), F.avg("association").alias("_as"), F.avg("conditional").alias("_co"), F.max("jaccard").alias("_ja"), F.sum("pair_count").alias("pairs"), F.first("_n").alias("_n")
    )
    raw = 0.40 * F.col("_as") + 0.25 * F.col("_co") + 0.15 * F.col("_ja") + 0.20 * F.sqrt(F.col("support") / F.col("_n")) + F.least(F.lit(0.10), 0.04 * (F.col("support") - 1))
    scored = fresh.select("conv", "candidate", "support", "pairs", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)) + TIE, 5).alias("score"))
    from tidemark.operators.evaluation import rank_within

    return rank_within(scored, ["conv"], [F.desc("score"), F.desc("support"), F.desc("pairs"), F.col("candidate")]).where(F.col("rank") <= k)
