"""Conversations folded without Python, texts that repeat looked up once: known answers, and what the plans hold."""

from pyspark.sql import functions as F

from tidemark.operators import cases, matching, questions
from tidemark.streaming import conversation, events

SAID = "conv long, turn long, code string, negated boolean"


def test_conversations_are_folded_natively_over_two_triggers(spark, tmp_path):
    """A row that repeats, a denial within a turn, turns that name nothing new, and a turn that comes late."""
    first = [(1, 1, "b", False), (1, 1, "b", False), (1, 2, "b", True), (1, 2, "b", False), (1, 4, "a", False), (2, 1, "c", True)]
    late = [(1, 3, "a", True), (3, 1, "d", False)]
    for rows in (first, late):
        spark.createDataFrame(rows, SAID).coalesce(1).write.mode("append").parquet(f"{tmp_path}/found")
    stream = spark.readStream.schema(SAID).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/found")
    out = conversation.folded(stream)
    assert "Python" not in out._jdf.queryExecution().logical().toString() and "Pandas" not in out._jdf.queryExecution().logical().toString()
    with conversation.state_store(spark):
        got = {r.conv: (r.positive, r.negated_codes, r.asked) for r in events.latest(out, "conv").collect()}
    assert got == {1: (["a"], ["b"], 2), 2: ([], ["c"], 0), 3: (["d"], [], 0)}


def test_repeated_texts_are_looked_up_once(spark):
    """The same matches as of each text by itself; the words of the texts are not in the plan that meets them."""
    said = ["I have no blue bolt.", "a Blue bolt, blue bolt but not red", "", None]
    texts = spark.range(40).selectExpr("id", f"element_at(array({', '.join('null' if x is None else repr(x) for x in said)}), cast(id % 4 + 1 as int)) AS text")
    aliases = spark.createDataFrame([("blue bolt", "B"), ("red", "R")], "alias string, code string")
    got, each = matching.contained_in_wordings(texts, aliases), matching.contained(texts, aliases)
    assert sorted(map(tuple, got.select(each.columns).collect())) == sorted(map(tuple, each.collect())) != []
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (got, each)]
    assert "Generate" not in plans[0] and "Generate" in plans[1]


def test_names_are_compared_with_a_text_at_once():
    """Names of up to 16, 32 and 63 letters and beyond, empty and longer than the text, texts over several blocks: as one by one."""
    import random

    import numpy as np

    from tidemark.functions import text

    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcde é") for _ in range(n))
    labels = ["", "a", "ab cd", "ÉB a", *[some(n) for n in (3, 9, 16, 17, 31, 32, 33, 62, 63, 64, 70)]]
    bounds = matching.NameBounds(labels, {})
    every = np.arange(len(labels))
    for t in ("", "a", "ab", "cd x ab", some(40), some(matching.STRETCHES - 1), some(2 * matching.STRETCHES + 7), "\U0001f600 ab\ud800"):
        assert bounds.partials(t, every).tolist() == [text.partial(x, t) for x in bounds.names]
        assert bounds.set_ratios(t, every) == [text.token_set(x, t) for x in bounds.names]


def test_spans_of_few_aliases_try_few_places_and_move_no_surroundings(spark):
    """Of places with one word of the alias only the first and nearest is tried; no words travel to be put around others."""
    near = {"blue": [("blue", 1.0, False)], "blur": [("blue", 0.8, False)], "bolt": [("bolt", 1.0, False)]}
    words = ["blur"] + ["x"] * 20 + ["blue"] + ["x"] * 20 + ["blue"] + ["x"] * 20 + ["bolt", "y", "blue"]
    assert matching.said_near(words, near, [("blue bolt", ["blue", "bolt"], ["blue", "bolt"])]) == [("blue bolt", [63, 65, 21])]
    assert matching.said_near(words[:60], near, [("blue bolt", ["blue", "bolt"], ["blue", "bolt"])]) == []
    texts = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "a blue bolt")], "id long, text string")
    aliases = spark.createDataFrame([("blue bolt", "B")], "alias string, code string")
    found = matching.spans(texts, aliases)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, found.collect())) == sorted(map(repr, matching.spans(texts, aliases, few=0).collect())) != []


def test_conversations_in_the_same_state_are_ranked_once(spark):
    """Order and repeats do not tell states apart; polarity and what was asked do. Each has the rows that it has by itself."""
    codes = "ABCDEF"
    graph = spark.createDataFrame([(a, b, 20 + i, 0.1 * i + 0.05, 0.4, 0.3, 0.2 + 0.1 * j) for i, a in enumerate(codes) for j, b in enumerate(codes) if a < b], "a string, b string, pair_count long, conditional double, reverse double, jaccard double, association double")
    ontology = spark.createDataFrame([(c, f"name {c}", f"Do you have {c * 4}?", "B", None, False) for c in codes], "code string, name string, question string, data_type string, values array<string>, antecedent boolean")
    told = [(1, "A", True), (1, "B", False), (2, "B", False), (2, "A", True), (2, "A", True), (3, "A", True), (3, "B", True), (4, "A", True), (4, "B", False), (5, "C", False), (6, None, True), (6, "A", True), (None, "A", True), (7, "A", True), (7, "B", None)]
    known = spark.createDataFrame(told, "conv long, code string, positive boolean")
    asked = spark.createDataFrame([(4, "C"), (8, "A")], "conv long, code string")
    got = {"next": cases.questions(known, graph, 3), "ranked": questions.ranked(known, graph, ontology, asked, 3)}
    each = {"next": cases._questions(known, graph, 3, 0.03, 10), "ranked": questions._ranked(known, graph, ontology, asked, 3, 0.03, 10)}
    for name, rows in got.items():
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, each[name].select(rows.columns).collect())) != []
    calls = []
    cases.once_a_state(known, lambda some, done: calls.append((some.select("conv").distinct().count(), done)) or some.select("conv", "code"))
    assert calls == [(4, None)]  # of seven conversations 1, 2, 4 and 7 are in one state


def test_candidates_stay_with_their_conversations(spark):
    """Candidates, many for each state, are grouped, held against what is known and ranked without a shuffle; bags give what their codes do."""
    codes = "ABCDEF"
    graph = spark.createDataFrame([(a, b, 20, 0.3, 0.4, 0.3, 0.2 + 0.1 * j) for a in codes for j, b in enumerate(codes) if a < b], "a string, b string, pair_count long, conditional double, reverse double, jaccard double, association double")
    bags = spark.createDataFrame([(1, ["A", "B"]), (2, ["B", "A"]), (3, ["C"]), (4, []), (5, ["B"]), (None, ["A"])], "case_id long, codes array<string>")
    known = bags.select(F.col("case_id").alias("conv"), F.explode("codes").alias("code")).withColumn("positive", F.col("code") != "B")
    plan = cases._questions(known.repartition("conv"), graph, 3, 0.03, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1
    got = cases.questions_of_bags(bags, lambda c: c != "B", graph, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, cases.questions(known, graph, 3).collect())) and {r.conv for r in got.collect()} == {1, 2, 3}


def test_known_codes_are_read_from_the_lines(spark, sf):
    """Codes that repeat in an order are counted once without bags being made and taken apart."""
    from tidemark.plans import corpus

    got = corpus.evidence_gate(spark, sf)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "Generate" not in plan
    bags = corpus.roles.bags(spark, sf).collect()
    assert {r.conv: r.n_positive for r in got.collect()} == {b.case_id: sum(int(c[2:4]) % 3 != 0 for c in b.codes) for b in bags}
