import math
from collections import Counter

import numpy as np
import regex

from tests.compare import difference, tables
from tidemark.llm import lexical_search, registry

TERM = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [regex.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def expected(items, docs, k=20):
    counts = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for row, (item, text) in enumerate(items):
        scored = []
        for doc, c in held:
            m = 75 + (25 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if s > 0:
                scored.append((-s, doc is not None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_against_brute_force(spark, docs, nothing):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(1, "Alpha beta beta, gamma's don't 12345"), (1, "straße 東京 ünïcode"), (2, None), (3, "..."), (None, "the le y eta"), (4, "alpha " * 50), (5, "nowhere")]
    frame = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "'x' AS _row")
    assert rows(lexical_search.search(frame, docs)) == expected(items, texts)
    # blocks of items and of documents are a matter of memory alone
    assert rows(lexical_search.search(frame, docs, item_block_bytes=60, block_docs=2, block_bytes=500)) == expected(items, texts)
    assert rows(lexical_search.search(frame, docs, k=2)) == expected(items, texts, 2)
    assert rows(lexical_search.search(frame, nothing)) == [] == rows(lexical_search.search(frame.where("false"), docs))


def test_copies_tie_by_id_and_repeat(spark):
    texts = [(i % 40 if i % 7 else None, "one two" if i % 3 else f"one w{i} w{i}") for i in range(300)]
    items = [(7, "one two"), (8, "two two w3")]
    frame = spark.createDataFrame(texts, "doc_id int, text string").repartition(5)
    found = lexical_search.search(spark.createDataFrame(items, "item_id int, text string"), frame, block_docs=16)
    assert rows(found) == expected(items, texts)


def test_ids_of_text(spark):
    frame = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("é", "x"), ("z", "q")], "doc_id string, text string")
    found = lexical_search.search(spark.createDataFrame([("i", "y")], "item_id string, text string"), frame)
    assert [(r.rank, r.doc_id) for r in found.orderBy("rank").collect()] == [(1, "a"), (2, "b")]


def test_best_values_and_large_numbers():
    v = np.asarray([5, 9, 9, 1, 9, 0])
    assert lexical_search.leading(v, 2, 1).tolist() == [1, 2] and lexical_search.leading(v, 4, 6).tolist() == [1, 2, 4]
    assert lexical_search.length_factor(np.asarray([10**6, 2], dtype="u4"), 10**13, 10**16).tolist() == [75 + 25 * 10**6 // 1000, 75]


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(registry.QUERIES["op11_lexical_search"](spark, sf), tables(sf).sql(registry.ORACLES["op11_lexical_search"])) is None
