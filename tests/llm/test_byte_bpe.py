import base64
import hashlib

import public_tokenizers as P
import tiktoken

from tidemark.llm import byte_bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_library_s(docs, sample):
    lib = library()
    for frame in (docs, sample):
        got = {r[0]: list(r[1]) for r in byte_bpe.encode(frame, RANKS, P.PATTERN).collect()}
        assert got == {r.doc_id: lib.encode_ordinary(r.text or "") for r in frame.select("doc_id", "text").collect()}


def test_random_bytes_in_words(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("aeinrsté一!? 1\n") for _ in range(rng.randint(0, 400))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lib = library()
    assert all(list(r[1]) == lib.encode_ordinary(texts[r[0]]) for r in byte_bpe.encode(frame, RANKS, P.PATTERN).collect())


def test_round_trip(docs, nothing):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    lib = library()
    rows = byte_bpe.round_trip(docs, RANKS, P.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    decoded = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS)
    assert {r[0]: bytes(r[1]).decode() for r in decoded.collect()} == texts
    assert byte_bpe.round_trip(nothing, RANKS, P.PATTERN).collect() == []


def test_repeated_rows_and_a_very_long_text(spark):
    from tests.llm.conftest import prose

    rows = [(1, "one two"), (1, "one two"), (2, prose(8, 60_000)), (None, "a" * 3000), (3, None)]
    got = byte_bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), RANKS, P.PATTERN).collect()
    lib = library()
    want = sorted(((i or 0, len(lib.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows))
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in got) == want
