from collections import Counter, defaultdict

import numpy as np
import regex
from hypothesis import given
from hypothesis import strategies as st

from tests.compare import difference, tables
from tidemark.llm import registry, source_divergence

TERM = regex.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def expected(rows, min_docs=10, k=10):
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        ts = [regex.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        counts[lang or "", source or ""].update(ts)
        df[lang or ""].update(set(ts))
    out = []
    for lang, source in counts:
        kept = sorted(t for t, n in df[lang].items() if n >= min_docs)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = share(counts[lang, source])
        q = share(sum((c for (x, _), c in counts.items() if x == lang), Counter()))
        pairs = []
        for x, other in counts:
            if x == lang and other != source:
                r = share(counts[x, other])
                pairs.append((other, sum(f(p[t], r[t]) for t in kept)))
        named = [(t, f(p[t], q[t])) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", named)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, v, r) for r, (item, v) in enumerate(found, 1) if part == "pair" or r <= k]
    return sorted(out)


def got(frame, **how):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in source_divergence.audit(frame, **how).collect())


def table_of(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS document", "'z' AS item").repartition(5)


def made(n):
    words = ["One", "one", "two", "tré", "東京", "x1y", "don't", "Éa", "a-b", "z", "zz"]
    return [
        (" ".join(words[(i * j + i // 3) % len(words)] for j in range(i % 13)) if i % 17 else None, [None, "", "en", "de", "en"][i % 5], ["s1", "s2", None, "é", "s1", "s1", "s9"][i % 7])
        for i in range(n)
    ]


def test_against_brute_force(spark):
    rows = made(400)
    frame = table_of(spark, rows)
    assert got(frame) == expected(rows)
    assert got(frame, min_docs=1, k=3) == expected(rows, 1, 3)
    # blocks and slices are a matter of memory alone
    assert got(frame, block_bytes=40, slice_bytes=100) == expected(rows)


def test_sums_sent_on_batch_by_batch(spark):
    class Shared:
        value = {"en": ([f"s{i}" for i in range(6)], np.asarray([4] * 6), 2)}

    kept = spark.createDataFrame([("en", "a", ["s0", "s3"], [4, 1]), ("en", "b", ["s1", "s3"], [4, 3])], "lang string, term string, sources array<string>, counts array<long>").coalesce(1)
    whole = source_divergence.partial_results(kept, Shared, 10).where("part = 'pair'").groupBy("source", "item").sum("value").collect()

    parts = source_divergence.partial_results(kept, Shared, 10, held_pairs=8).where("part = 'pair'").groupBy("source", "item").sum("value").collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) and whole


def test_without_kept_terms_and_empty(spark):
    rows = [("a b", "en", "s"), (None, "en", "t"), ("c", "de", None), ("", None, "t")]
    assert got(table_of(spark, rows)) == expected(rows) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    assert got(table_of(spark, rows).where("false")) == []


def test_repeated_rows_and_a_hot_group(spark):
    rows = made(60) * 3 + [("same words here", "en", "s1")] * 300
    assert got(table_of(spark, rows)) == expected(rows)


@given(st.integers(0, 10**14), st.integers(0, 10**14), st.integers(1, 10**6))
def test_shares_are_exact(a, b, kept):
    n, total = min(a, b), max(a, b)
    assert source_divergence.shares(np.asarray([n]), np.int64(total), kept).tolist() == [1 + 10**9 * (n + 2) // (total + 2 * kept)]


def test_against_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert difference(registry.QUERIES["op13_source_divergence"](spark, sf), tables(sf).sql(registry.ORACLES["op13_source_divergence"])) is None
