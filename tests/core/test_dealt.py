"""Groups that are dealt by the number of rows: how many tasks and shuffles there are, and results that stay."""

from types import SimpleNamespace

import pandas as pd
import pytest

from tidemark.operators import lab_lines, locations, matching, ranking
from tidemark.session import dealt
from tidemark.sources import roles
from tidemark.streaming import caches


def test_dealt(spark):
    rows = spark.range(1000).selectExpr("id % 300 AS k", "id AS v")
    assert dealt(rows, "k", a_task=100).rdd.getNumPartitions() == 10
    assert dealt(rows.limit(0), "k").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert {r.k: r["sum(v)"] for r in dealt(rows, "k", a_task=100).groupBy("k").sum("v").collect()} == {k: sum(range(k, 1000, 300)) for k in range(300)}


def test_reports_are_shuffled_once(spark, capsys):
    lines = spark.createDataFrame([("d", 1, "Sodium: 1")], "doc string, no int, line string").repartition(7, "doc")
    names = spark.createDataFrame([("sodium", "na")], "alias string, kind string")
    lines.explain()
    before = capsys.readouterr().out.count("Exchange hashpartitioning(doc")
    found = lab_lines.report_items(lines, names)
    found.explain()
    plan = capsys.readouterr().out
    assert before == 1 == plan.count("Exchange hashpartitioning(doc") and "SortMergeJoin" not in plan


@pytest.mark.parametrize("lines, want", [
    (["Sodium: 1", "Na | 2 | x"], [("na", 1.0, "", 1, 1.0)]),
    (["unknown: Sodium  3 mmol", "Sodium\n9"], []),
    (["Sodium", " 1,4 g/dL", "12"], [("na", 14.0, "g/dL", 1, 0.9)]),
    (["| Sodium | <5.5 mmol/L (3-6) H", "Sodium: 7"], [("na", 5.5, "mmol/L", 1, 1.0)]),
    (["Na\x01x: 3", "Sodium: 4\x01\x01"], [("na", 4.0, "", 2, 1.0)]),
    (["systolic: 300", "BP 120/80", "nibp: 900/30"], [("systolic", 120.0, "mmHg", 2, 0.95), ("diastolic", 80.0, "mmHg", 2, 0.95)]),
    (["systolic: 300", "BP: 20/10 then 150/90 mm hg"], [("systolic", 300.0, "", 1, 1.0)]),
    ([None, "", "Na", "B12", "7 pg", "1 2", "Sodium: ,"], [("b12", 7.0, "pg", 4, 0.9)]),
])
def test_odd_reports(spark, lines, want):
    names = spark.createDataFrame([("sodium", "na"), ("Na", "na"), ("systolic", "systolic"), ("B12", "b12"), ("B12", "b12"), (None, "x")], "alias string, kind string")
    rows = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines, 1)], "doc string, no int, line string")
    assert sorted((r.kind, r.value, r.unit, r.line, r.confidence) for r in lab_lines.report_items(rows, names).collect()) == sorted(want)


def test_places_of_wordings(spark, monkeypatch, capsys):
    aliases = locations.location_aliases(spark.createDataFrame([("V_1", "knee(R)", 1), ("V_2", "upper chest", 2)], "value string, meaning string, ordinal int"))
    said = ["my knee hurts", "chest pain", "knee", None, "", "my knee hurts", "Chest pain; knee"] * 300
    texts = spark.createDataFrame(list(enumerate(said)), "id long, text string")
    want = {i: {"my knee hurts": ("V_1", "knee"), "chest pain": ("V_2", "chest pain"), "Chest pain; knee": ("V_2", "chest pain")}.get(x) for i, x in enumerate(said)}
    asked = []
    contained = matching.contained
    monkeypatch.setattr(matching, "contained", lambda t, a: asked.append(t) or contained(t, a))
    for few in (matching.FEW, 0):
        monkeypatch.setattr(matching, "FEW", few)
        rows = locations.pain_locations(texts, aliases).collect()
        assert {r.id: (r.value, r.matched) for r in rows} == {i: x for i, x in want.items() if x} and len(rows) == 1200
    assert asked[0].count() == 3  # wordings, not texts
    asked[0].explain()
    plan = capsys.readouterr().out
    assert plan.index("arrays_overlap") < plan.index("HashAggregate")  # the plan is written from its end


class Kept:
    """State of one key in memory, with the timers that are set."""

    def __init__(self):
        self.states, self.timers = {}, []

    def getListState(self, name, schema):
        return self.states.setdefault(name, State())

    getValueState = getListState

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class State:
    value = None

    def get(self):
        return self.value if isinstance(self.value, tuple) or self.value is None and self.single else iter(self.value or [])

    single = False

    def update(self, value):
        self.value = value

    put = update

    def appendList(self, more):
        self.value = [*(self.value or []), *more]

    def clear(self):
        self.value = None


def test_a_key_has_one_timer():
    handle, ttl, big = Kept(), 10, 2**60
    handle.getListState("timer", "").single = True
    fold = caches.ExpiringAnswers(ttl)
    fold.init(handle)
    rows = [(0, 1_000_000 * t, False, "FOUND", d) for t, d in ((5, "a"), (5, "b"), (20, None), (21, "c"))] + [(big + t, 1_000_000 * t, True, None, None) for t in (1, 5, 14, 15, 20, 22, 40)]
    frame = pd.DataFrame(rows, columns=["ask_id", "us", "asked", "status", "detail"])
    assert list(fold.handleInputRows(("k",), iter([frame[:3], frame[3:]]), None)) == []
    assert handle.timers == [1001]
    told, fired, marks = {}, 0, (500, 6000, 20_500, 100_000)
    for mark in marks:
        while due := [t for t in handle.timers if t <= mark]:
            assert len(due) == 1
            handle.timers.remove(due[0])
            fired += 1
            for out in fold.handleExpiredTimer(("k",), SimpleNamespace(getCurrentWatermarkInMs=lambda m=mark: m), None):
                told.update({r.ask_id - big: (r.status, r.detail) for r in out.itertuples()})
    assert fired == 3 and handle.timers == [] and all(s.value is None for s in handle.states.values())
    assert told == {1: ("MISS", None), 5: ("FOUND", "b"), 14: ("FOUND", "b"), 15: ("MISS", None), 20: ("FOUND", None), 22: ("FOUND", "c"), 40: ("MISS", None)}


def test_quantiles_read_their_input_once(spark, capsys):
    found = ranking.quantiles(spark.range(1001).selectExpr("id % 2 AS g", "double(id) AS v"), "v", {"m": 0.5}, ("g",))
    found.explain()
    assert "Range (" not in capsys.readouterr().out
    assert sorted(map(tuple, found.collect())) == [(0, 501, 0.0, 1000.0, 500.0), (1, 500, 1.0, 999.0, 500.0)]


def test_bags_are_dealt_by_the_number_of_lines(spark, sf, capsys):
    bags = roles.bags(spark, sf)
    bags.explain()
    plan = capsys.readouterr().out
    assert "REPARTITION_BY_NUM" in plan and "Exchange hashpartitioning(case_id" not in plan and plan.count("Exchange hashpartitioning(l_orderkey") == 1
    assert bags.count() == bags.select("case_id").distinct().count() > 0


def test_distinct_words(spark, sf):
    odd = ["I don't; DONT", "it’s ’tis ''", "a.5 b. .7 c..8 x.y 1.2.3", None, "", " . ' ", "im I'M i'm's can'tdo", "naïve Ünder\nnew\tline..", "won't.5 .won't 5.won't"]
    for texts in (spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "id long, text string"), spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("doc_id", "id")):
        want = {w for r in matching.prepared(texts).select("words").collect() for w in r.words}
        got = [r.word for r in matching.distinct_words(texts).collect()]
        assert set(got) == want and len(got) == len(want)


def test_near_words_are_looked_for_in_all_tasks(spark):
    words = spark.range(3000).selectExpr("concat('word', id) AS word")
    names = spark.createDataFrame([("words bolt", "B")], "alias string, code string")
    found = matching.fuzzy(words, names)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert found.where("word = 'word1'").count() == 1
