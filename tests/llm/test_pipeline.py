import numpy as np
import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []
    from tidemark.llm.common import durable

    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = durable(stage(spark, docs, "/root/testdata/sf0.001"))
        out.append((name, before, docs))
    return out


def test_order_and_columns(stages):
    assert [n for n, *_ in stages] == ["language_id", "exact_dedup", "simhash_near_dedup", "substring_dedup", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_works_on_what_was_kept(stages):
    ids = [({r.doc_id for r in b.collect()}, {r.doc_id for r in a.collect()}) for _, b, a in stages]
    for before, after in ids:
        assert after <= before
    assert ids[3][0] == ids[3][1] == ids[4][1]


def test_decisions_take_effect(stages):
    from tests.llm.test_exact_dedup import expected
    from tests.llm.test_simhash_trie import brute

    (_, b1, a1), (_, b2, a2) = stages[1], stages[2]
    rows = [(r.doc_id, r.text) for r in b1.collect()]
    assert {r.doc_id for r in a1.collect()} == {k for k, *_ in expected(rows).values()}
    rows = [(r.doc_id, r.text) for r in b2.collect()]
    assert {r.doc_id for r in a2.collect()} == {c for _, c in brute(rows).values()}


def test_same_rows_twice(spark, stages):
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    again = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    totals = lambda f: {r.doc_id: r.n for r in f.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert again.columns == stages[-1][2].columns and set(cols) <= set(again.columns)
    assert totals(again) == totals(stages[-1][2])
    assert np.all([v > 0 for v in totals(again).values()])


def test_null_and_repeated_ids_leave_one_row_of_each_group(spark):
    from tests.llm.conftest import prose

    a, b, c, d = (prose(i, 80) for i in range(200, 204))
    rows = [(1, a), (1, a), (None, a), (None, b), (None, b), (2, c), (2, d), (None, c + " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    exact = corpus_pipeline.drop_exact_copies(spark, docs, "")
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(map(tuple, exact.collect()), key=key) == sorted([(1, a), (None, b), (2, d), (None, c + " ")], key=key)
    near = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(map(tuple, near.collect()), key=key) == sorted([(1, a), (None, b), (2, c), (2, d)], key=key)


def test_rows_without_a_language_go_whatever_their_ids(spark):
    rows = [(i, "the cat sat on the mat and saw the dog", "en") for i in range(20)] + [(i, "der Hund und die Katze sind im Haus", "de") for i in range(20, 40)]
    docs = spark.createDataFrame([*rows, (None, "the cat and the dog", "en"), (None, "12 34", "en"), (3, None, "en")], "doc_id long, text string, lang string")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == 41 and kept.where("text is null or text = '12 34'").count() == 0


def test_first_fourth_and_fifth_stage_against_their_rules(stages):
    import zlib

    import public_tokenizers
    import regex
    import tokenizers

    texts = lambda f: {r.doc_id: r.text for r in f.select("doc_id", "text").collect()}
    (_, b1, a1), (_, b4, a4), (_, b5, a5) = stages[0], stages[3], stages[4]
    assert texts(a1) == {i: t for i, t in texts(b1).items() if t and regex.search(r"\p{L}", t)}
    before, after = texts(b4), texts(a4)
    for i, text in after.items():  # what is left of a text is in its order
        rest = iter(before[i].split())
        assert all(w in rest for w in text.split())
    tokenizer = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts(b5).items()}
    pieces, places = {}, {}
    for r in a5.collect():
        assert r.doc_tokens == len(ids[r.doc_id])
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.asarray(part, "<u4").tobytes()) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for runs, whole in [*((v, len(ids[i])) for i, v in pieces.items()), *((v, None) for v in places.values())]:
        runs.sort()
        assert runs[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(runs, runs[1:])) and (whole is None or sum(n for _, n in runs) == whole)
        assert whole is not None or sum(n for _, n in runs) <= 2048
    assert set(pieces) == set(ids)


def test_fourth_stage_against_brute_force(spark, stages):
    """Paragraphs compared all with all: of equal and similar ones the first occurrence stays, runs of 13 words or more go."""
    from collections import Counter

    from tidemark.llm.paragraph_dedup import Paragraphs

    (_, before, after) = stages[3]
    rows = before.selectExpr("xxhash64(doc_id, text) AS k1", "xxhash64('2', text, doc_id) AS k2", "doc_id", "text").collect()
    places, words, cuts = {}, {}, {}
    for r in rows:
        p, words[r.doc_id] = Paragraphs(r.text), (r.text or "").split()
        low = [w.decode() for w in (r.text or "").encode().lower().split()]
        cuts[r.doc_id] = list(zip(p.first.tolist(), p.size.tolist(), strict=True))
        for no, (first, size) in enumerate(cuts[r.doc_id]):
            if size >= 5:
                places.setdefault(tuple(low[first : first + size]), []).append((r.k1, r.k2, no, r.doc_id))
    texts = list(places)
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    holders, up = {}, list(range(len(texts)))
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                up[root(i)] = root(j)
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(root(i), []).extend(places[t])
    gone = {}
    for found in groups.values():
        for _, _, no, doc in sorted(found)[1:]:
            gone.setdefault(doc, set()).add(no)
    assert sum(map(len, gone.values())) > 50
    left = {r.doc_id: (r.text or "").split() for r in after.collect()}
    for doc, numbers in ((d, gone.get(d, set())) for d in left):
        kept, run = [], []
        for no, (first, size) in [*enumerate(cuts[doc]), (None, (0, 0))]:
            part = words[doc][first : first + size]
            if no in numbers:
                run += part
            else:
                kept, run = kept + (run if len(run) < 13 else []) + part, []
        assert left[doc] == kept, doc
