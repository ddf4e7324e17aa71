"""Packing along a space-filling curve: neighbouring documents share training sequences.

Every document is tokenized whole, its hashed token vector is projected to a few dimensions, the documents are
range-sorted by the Hilbert key of that point, and each range is cut into sequences in curve order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable

#: Parts of texts and words remembered by each worker before that memory is emptied.
PART_MEMORY, WORD_MEMORY = 600_000, 500_000
#: Control characters that Python's split takes for white space and the tokenizer doesn't.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: Fixed values of the word tokenizer: its word pattern, written out for Latin-1 text in lower case, and the space.
LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\x00a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+|\x00")


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for 256 and up, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of whole texts by a tokenizer file that never joins what white space separates.

    Such a tokenizer's ids of a text are those of its white-space-separated parts, one after the other. Each distinct
    part is encoded once and remembered, within a bounded memory: parts of Latin-1 letters word by word through the
    library's merges, all others by the library as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.odd = ["\x00", *ODD_SPACE, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self.letters = byte_letters()
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {"\x00": b""}

    def encode(self, text: str) -> np.ndarray:
        if any(x in text for x in self.odd):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        parts = (text.lower() if text.isascii() else text).split()  # the tokenizer lowers what it reads
        memory = self.parts
        if unseen := set(parts).difference(memory):
            if len(memory) + len(unseen) > PART_MEMORY:
                memory = self.parts = {}
                unseen = set(parts)
            self.learn(list(unseen))
        return np.frombuffer(b"".join(map(memory.__getitem__, parts)), dtype="<u4")

    def learn(self, parts: list[str]) -> None:
        latin, other = [], []
        for x in parts:
            try:
                x.encode("latin-1")
                latin.append(x)
            except UnicodeEncodeError:
                other.append(x)
        memory, words, word_ids = self.parts, self.words, self.word_ids
        for x in other:
            memory[x] = np.asarray(self.tokenizer.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(words) > WORD_MEMORY:
            words = self.words = {"\x00": b""}
        held: list[bytes] = []
        at = 0
        for w in LATIN_WORDS.findall("\x00".join(latin).lower() + "\x00" * bool(latin)):
            if w == "\x00":
                memory[latin[at]] = b"".join(held) if len(held) != 1 else held[0]
                at += 1
                held = []
            else:
                ids = words.get(w)
                if ids is None:
                    ids = words[w] = word_ids(w)
                held.append(ids)

    def word_ids(self, word: str) -> bytes:
        spelled = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.merges(spelled)])


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (rows, dims), each coordinate below 2**bits; dims * bits <= 63.

    Skilling's transform ("Programming the Hilbert curve", 2004), on all rows at once.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # inverse undo of the excess work
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, dims):  # Gray encoding
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def id_type(vocabulary: int, end_id: int) -> str:
    """How ids travel: two bytes each if all of them fit, else four."""
    return "<u2" if max(vocabulary - 1, end_id) < 1 << 16 else "<u4"


def projection(dims: int, buckets: int = 1 << 16, seed: int = 7) -> np.ndarray:
    """Gaussian rows for hashed token buckets: the projection of a hashed document vector is the mean of its rows."""
    return np.random.default_rng(seed).standard_normal((buckets, dims)).astype(np.float32)


def encode_along_curve(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, end_id: int, dims: int, bits: int) -> DataFrame:
    """``_id, _key, _ids`` of every document: its Hilbert key and its token ids with the end id, little-endian.

    The ids take two bytes each where the vocabulary allows it and else four; see ``id_type``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, table = WordTokenizer(tokenizer_path), projection(dims)
        kind = id_type(tokenizer.tokenizer.get_vocab_size(), end_id)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                encoded, points = [], []
                for text in part.column(1).to_pylist():
                    ids = tokenizer.encode(text or "")
                    # mean projection, stretched by a fixed factor and squashed into the unit interval
                    mean = table[ids & 0xFFFF].mean(axis=0) if len(ids) else np.zeros(dims, dtype=np.float32)
                    points.append(np.floor((np.tanh(4 * mean) + 1) * ((1 << bits) - 1) / 2))
                    encoded.append(np.append(ids, np.uint32(end_id)).astype(kind).tobytes())
                keys = hilbert_keys(np.asarray(points), bits)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.int64()), pa.array(encoded, pa.binary())], names=["_id", "_key", "_ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, _key long, _ids binary")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 2048,
    end_id: int = 1,
    dims: int = 4,
    bits: int = 12,
    ranges: int | None = None,
) -> DataFrame:
    """Packs every document into sequences of at most ``length`` ids; one row per piece of a document.

    Columns: ``id_col, start, length, doc_tokens, sequence_id, offset, ids`` (the piece's ids as little-endian uint32).
    Null and empty texts are one piece holding ``end_id`` alone. Long documents run on over as many sequences as they
    fill. Each range of the curve fills its sequences to the brim but for the last one, so padding is under one sequence
    a range. Ties on the curve (copies of one text) are ordered, and split between ranges, by id. Columns of ``docs``
    besides the two named are ignored; an empty table gives no rows; repeated ids are packed as separate documents.

    One range shuffle moves the ids. A task holds one Arrow batch and one open sequence, never a whole range.
    """
    # written once: the sampling of range bounds would otherwise tokenize everything a second time
    encoded = durable(encode_along_curve(docs, tokenizer_path, id_col, text_col, end_id, dims, bits))
    from tokenizers import Tokenizer

    kind_of_ids = id_type(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id)
    order = [F.col("_key"), F.col("_id")]
    ranged = encoded.repartitionByRange(ranges, *order) if ranges else encoded.repartitionByRange(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        width = np.dtype(kind_of_ids).itemsize
        sequence, filled = 0, 0
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")}
            held = 0
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = raw.as_buffer()
                total, start = raw.size // width, 0
                while start < total:
                    n = min(length - filled, total - start)
                    ids = np.frombuffer(raw, kind_of_ids, n, width * start).astype("<u4").tobytes()
                    row = (key, start, n, total, base + sequence, filled, ids)
                    for name, value in zip(out, row, strict=True):
                        out[name].append(value)
                    held += n
                    start += n
                    filled += n
                    if filled == length:
                        sequence, filled = sequence + 1, 0
                if held > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(v, schema.field(k).type) for k, v in out.items()], schema=schema)
                    out, held = {k: [] for k in out}, 0
            if out["_id"]:
                yield pa.RecordBatch.from_arrays([pa.array(v, schema.field(k).type) for k, v in out.items()], schema=schema)

    kind = docs.schema[id_col].dataType.simpleString()
    key_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    schema = pa.schema([("_id", key_type), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
    pieces = ranged.sortWithinPartitions(*order).select("_id", "_ids").mapInArrow(cut, f"_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return pieces.select(F.col("_id").alias(id_col), "start", "length", "doc_tokens", "sequence_id", "offset", "ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences from the pieces of ``pack``: ``sequence_id, length, ids`` (little-endian uint32, in order)."""
    part = F.struct("offset", "ids")
    joined = F.aggregate(F.array_sort(F.collect_list(part)), F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def unpack(ids: bytes) -> np.ndarray:
    """The ids of a piece or sequence."""
    return np.frombuffer(ids, dtype="<u4")


def padding(pieces: DataFrame, length: int = 2048) -> DataFrame:
    """One row: sequences, ids, and padded places when every sequence but those at a power of two is filled up."""
    per = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return per.agg(F.count("*").alias("sequences"), F.sum("n").alias("ids"), F.sum(F.when(power, 0).otherwise(length - F.col("n"))).alias("padding"))
