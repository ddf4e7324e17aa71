"""Contracts in both modes, aggregates joined back to rows of hot groups, typed literals and nested documents."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cleaning, contracts, evaluation, serving
from tidemark.sources import readers


def rules():
    return {"positive": F.col("v") > 0, "named": F.col("name") != ""}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, 1.0, "a"), (2, -1.0, ""), (3, None, "c"), (4, 2.0, None), (5, 3.0, "e")], "id long, v double, name string")


def test_rows_set_apart_in_one_pass(rows):
    good, bad, counts = contracts.set_apart(rows, rules())
    assert sorted(r.id for r in good.collect()) == [1, 5] and good.columns == rows.columns
    assert {r.id: r.problem for r in bad.collect()} == {2: "positive", 3: "positive", 4: "named"}
    assert counts == {"rows": 5, "positive": 2, "named": 1}
    good, bad, counts = contracts.set_apart(rows.where("false"), rules())
    assert good.count() == bad.count() == 0 and counts == {"rows": 0, "positive": 0, "named": 0}


def test_broken_contract_fails_the_job(rows):
    assert contracts.required(rows.where("id in (1, 5)"), rules()).count() == 2
    with pytest.raises(Exception, match="row breaks the rule: named.*\\bid\\W+4"):
        contracts.required(rows.where("id <> 2 and id <> 3"), rules()).collect()
    assert [r.id for r in contracts.required(rows.where("id = 5"), {}).collect()] == [5]


def test_counts_are_joined_back_where_a_hot_group_is(spark):
    rows = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'hot' ELSE concat('k', id div 6) END AS key", "id % 2 AS part", "id")
    got = evaluation.with_group_size(rows, ("key", "part"), "n").groupBy("n").count().collect()
    assert {r.n: r["count"] for r in got} == {1000: 4000, 1: 2000}
    obs = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), k, v, None) for k, v in (("a", 1.0), ("a", 1.0), ("b", 1.0), (None, 2.0), (None, 2.0), (None, 2.0))], "entity long, ts timestamp_ntz, kind string, value double, unit string")
    assert sorted((r.kind or "", r.copies) for r in cleaning.repeated_members(obs).collect()) == [("", 3)] * 3 + [("a", 2)] * 2
    assert cleaning.repeated_members(obs.where("false")).count() == 0


@pytest.mark.parametrize("text, path, kind, want", [
    ("{'a': 1, 'b': [True, None]}", "$.a", "int", (1, None)), ("{'a': 1}", "$.b", "int", (None, "missing")), ("{'a': 'x'}", "$.a", "int", (None, "wrong type")), ("{'a': None}", "$.a", "string", (None, "missing")),
    ("['x', \"it's\"]", "$[0]", "string", (None, "not a literal")), ('["x", "it\'s"]', "$[1]", "string", ("it's", None)), ("['say \"no\"']", "$[0]", "string", ('say "no"', None)), ("", "$.a", "int", (None, "empty")), (None, "$.a", "int", (None, "null")), ("{'a': 1", "$.a", "int", (None, "not a literal")),
])
def test_literals(spark, text, path, kind, want):
    row = spark.createDataFrame([(text,)], "t string").select(readers.literal_field(readers.typed_literal(F.col("t")), path, kind).alias("f")).first().f
    assert (row.value, row.problem) == want


def test_nested_documents(spark):
    people = spark.createDataFrame([(1,), (2,)], "id long")
    notes = spark.createDataFrame([(1, i, f"n{i}") for i in range(50)] + [(3, 1, "x")], "id long, at long, text string")
    found = {r.id: r for r in serving.documents(people, "id", {"notes": (notes, [F.desc("at")], 3), "none": (notes.where("false"), [F.col("at")], 2)}).collect()}
    assert [x.text for x in found[1].notes] == ["n49", "n48", "n47"] and found[2].notes == [] and found[1].none == [] and set(found) == {1, 2}
