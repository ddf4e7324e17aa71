import hashlib
import re

from tests.compare import difference, tables
from tidemark.llm import exact_dedup, registry


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def test_against_brute_force(docs):
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: tuple(r)[1:] for r in exact_dedup.exact_duplicates(docs).collect()}
    assert got == want


def test_repeated_rows_empty_table_and_filter(docs, nothing):
    assert exact_dedup.exact_duplicates(nothing).collect() == []
    assert exact_dedup.exact_duplicates(docs.unionByName(docs)).count() == 2 * docs.count()
    kept = exact_dedup.keep_first_of_equal(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({k for k, *_ in expected([(r.doc_id, r.text) for r in docs.collect()]).values()})


def test_a_third_in_one_group(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same text' ELSE concat('text ', id) END AS text")
    got = exact_dedup.exact_duplicates(rows)
    assert got.where("group_size = 1000 AND keep_id = 0").count() == 1000 and got.where("kept").count() == 2001


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(registry.op6_exact_dedup(spark, sf), tables(sf).sql(registry.ORACLES["op6_exact_dedup"])) is None


def test_no_python_in_the_plan(docs):
    plan = exact_dedup.exact_duplicates(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
