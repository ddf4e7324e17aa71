import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tidemark.llm import curve_packing

PATH = P.path("word_bpe_49k.json")


def check(frame, pieces):
    lib = Tokenizer.from_file(PATH)
    want = {r.doc_id: [*lib.encode(r.text or "", add_special_tokens=False).ids, 1] for r in frame.select("doc_id", "text").collect()}
    docs, seqs = {}, {}
    for r in pieces.collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0 and r.doc_tokens == len(want[r.doc_id])
        assert want[r.doc_id][r.start : r.start + r.length] == ids
        docs.setdefault(r.doc_id, []).append((r.start, r.length))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(docs) == set(want)
    for spans, total in [*((v, len(want[k])) for k, v in docs.items()), *((v, None) for v in seqs.values())]:
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at == total if total is not None else at <= 2048


def test_every_id_once_and_gapless(docs, sample, nothing):
    check(docs, curve_packing.pack(docs, PATH))
    check(sample, curve_packing.pack(sample, PATH, ranges=2))
    assert curve_packing.pack(nothing, PATH).collect() == []


def test_little_padding(sample):
    pieces = curve_packing.pack(sample, PATH, ranges=2)
    row = curve_packing.padding(pieces).first()
    assert row.padding <= 2 * 2048
    whole = {r.sequence_id: r for r in curve_packing.sequences(pieces).collect()}
    assert sum(r.length for r in whole.values()) == row.ids and all(len(r.ids) == 4 * r.length for r in whole.values())


def test_hilbert_curve_is_one_path():
    bits = 3
    points = np.asarray([(x, y) for x in range(8) for y in range(8)])
    order = points[np.argsort(curve_packing.hilbert_keys(points, bits))]
    assert sorted(curve_packing.hilbert_keys(points, bits).tolist()) == list(range(64))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_checksum(docs):
    from pyspark.sql import functions as F

    for r in curve_packing.pack(docs, PATH).select("ids", F.crc32("ids").alias("c")).collect():
        assert r.c == zlib.crc32(r.ids)


def test_repeated_rows_and_a_very_long_text(spark):
    from tests.llm.conftest import prose

    rows = [(1, "one two three"), (1, "one two three"), (2, prose(8, 60_000)), (None, "x"), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    lib = Tokenizer.from_file(PATH)
    sizes = [len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows]
    pieces = curve_packing.pack(frame, PATH).collect()
    assert sum(r.length for r in pieces) == sum(sizes) and all(r.offset + r.length <= 2048 for r in pieces)
    assert sum(r.length for r in pieces if r.doc_id == 1) == 2 * sizes[0] and sum(r.length for r in pieces if r.doc_id == 2) == sizes[2]
