import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bin_slack_packing as packing

PATH = P.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.integers(0, 60))
def test_fullest_is_the_best_of_all_subsets(lengths, room):
    counts = Counter(lengths)
    taken = packing.fullest(dict(counts), room)
    assert all(m <= counts[k] for k, m in taken.items())
    every = max(s for n in range(len(lengths) + 1) for c in itertools.combinations(lengths, n) if (s := sum(c)) <= room)
    assert sum(k * m for k, m in taken.items()) == every


def bins_one_by_one(lengths, size):
    """Minimum bin slack without combinations taken several times at once."""
    left, bins = Counter(lengths), 0
    while +left:
        first = max(+left)
        left[first] -= 1
        left -= Counter(packing.fullest(dict(+left), size - first))
        bins += 1
    return bins


def test_plan_packs_every_piece_as_well_as_bin_by_bin():
    for seed in range(6):
        rng = random.Random(seed)
        lengths = [rng.choice([rng.randint(1, 100), rng.randint(30, 60), 51, 100]) for _ in range(400)]
        combos = packing.plan(dict(Counter(lengths)), 100)
        used = Counter()
        for times, c in combos:
            assert times > 0 and sum(k * m for k, m in c.items()) <= 100
            used.update({k: m * times for k, m in c.items()})
        bins = sum(t for t, _ in combos)
        assert used == Counter(lengths) and bins <= bins_one_by_one(lengths, 100) + 1
        assert bins >= -(-sum(lengths) // 100)
    assert packing.plan({}, 10) == [] and packing.plan({10: 3}, 10) == [(3, {10: 1})]


def check(frame, pieces, end_id=0, size=2048):
    lib = Tokenizer.from_file(PATH)
    want = Counter(tuple([r.doc_id, *lib.encode(r.text or "", add_special_tokens=False).ids, end_id]) for r in frame.select("doc_id", "text").collect())
    crcs = Counter()
    for (i, *ids), n in want.items():
        for piece, s in enumerate(range(0, len(ids), size)):
            own = np.asarray(ids[s : s + size], "<u4")
            crcs[i, piece, s, len(own), zlib.crc32(own.tobytes())] += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == crcs
    bins = {}
    for r in pieces:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= size
    return len(bins)


def test_every_piece_has_a_place(spark, docs, sample, nothing):
    check(docs, packing.pack(docs, PATH, with_ids=False).collect())
    check(docs.unionByName(docs), packing.pack(docs.unionByName(docs), PATH, with_ids=False).collect())
    check(docs, packing.pack(docs, PATH, size=7, end_id=3).collect(), 3, 7)
    assert packing.pack(nothing, PATH).collect() == []
    pieces = packing.pack(sample.repartition(7), PATH).collect()
    n = check(sample, pieces)
    long = [r.length for r in pieces]
    assert n <= -(-sum(long) // 2048) + 1
    assert all(zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) == r.ids_crc32 for r in pieces)


def test_a_hot_length_and_clashing_names(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'one two three' ELSE repeat('word ', int(id % 50)) END AS text", "id AS piece", "id AS _task", "id AS _nth", "'x' AS ids")
    pieces = packing.pack(rows.repartition(9), PATH, size=64).collect()
    assert check(rows, pieces, size=64) <= -(-sum(r.length for r in pieces) // 64) + 1


def test_ranks_go_over_groups_of_tasks(spark):
    rows = spark.range(6000).selectExpr("int(id % 3000) AS _task", "id % 2 AS length")
    before, totals = packing.ranks(rows)
    assert {r["length"]: r["n"] for r in totals.collect()} == {0: 3000, 1: 3000}
    for r in before.collect():
        assert r["_before"] == 2 * (r["_task"] // 2)
