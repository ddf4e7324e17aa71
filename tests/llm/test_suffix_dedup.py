import hashlib
import random

from tests.llm.conftest import prose
from tidemark.llm import suffix_dedup


def brute(texts, threshold):
    raws = {i: (t or "").encode() for i, t in texts}
    seen = {}
    for i, raw in raws.items():
        for p in range(len(raw) - threshold + 1):
            seen.setdefault(raw[p : p + threshold], []).append((i, p))
    out = {}
    for i, raw in raws.items():
        gone = bytearray(len(raw))
        for places in seen.values():
            if len(places) > 1:
                for j, p in places:
                    if j == i:
                        gone[p : p + threshold] = b"\1" * threshold
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(frame, threshold=200, crowded=None):
    want = brute([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()], threshold)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(frame, threshold=threshold, crowded=crowded).collect()}
    assert got == want


def test_fixture(docs, nothing):
    check(docs)  # the longest has about 80,000 bytes
    short = docs.where("length(text) < 5000 OR text IS NULL")
    check(short, 40)
    check(short, 40, crowded=0)
    assert suffix_dedup.digests(nothing).collect() == []


def test_planted_passages(spark):
    rng = random.Random(5)
    passages = [prose(100 + i, rng.randint(10, 90)) for i in range(6)]
    texts = []
    for i in range(60):
        parts = [prose(1000 + i, rng.randint(0, 60))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            cut = rng.randint(0, 40)
            parts += [p[cut:], prose(rng.randint(0, 10**6), rng.randint(0, 20))]
        texts.append("".join(parts))
    texts += ["é" * 150, "é" * 150, "z" * 199, "z" * 199, "y" * 200, "q" * 201, None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for crowded in (None, 5, 0):  # anchors of a name in one task, some by rounds of joins, all so
        check(frame, crowded=crowded)


def test_repeated_rows(spark):
    frame = spark.createDataFrame([(1, "x" * 10 + prose(3, 60)), (1, "x" * 10 + prose(3, 60)), (2, prose(3, 60))], "doc_id long, text string")
    rows = suffix_dedup.digests(frame).collect()
    assert len(rows) == 3 and all(r.n_removed > 0 for r in rows)
