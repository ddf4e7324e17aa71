"""Byte-level BPE encoding by longest matches with backtracking, and decoding.

Bytes are read as Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds every token that
starts at every place of a word in one pass. Tokens are laid down longest first; a token may follow another only if the
two are compatible, that is if merging their joined bytes gives back exactly those two; otherwise shorter tokens are
tried, then the last token is taken back. Places once found to lead nowhere are not visited again, so the work is linear
in the word. A sequence whose neighbours are all compatible is the one that the merges produce.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words and pairs remembered by each worker before its memory is emptied.
WORD_MEMORY, PAIR_MEMORY = 500_000, 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(word: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Plain merges: the adjacent pair of lowest rank (under ``below``), leftmost first, until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if best[0] >= (below if below is not None else 1 << 60):
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


class BacktrackingBPE:
    """Exact BPE of words by longest matches and memoised compatibility of adjacent tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.size_of = {r: len(b) for b, r in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[int, int] = {}
        reachable = {}
        for token, rank in ranks.items():
            # a token that merges never reach can only be a whole word, which is looked up before
            if len(token) == 1 or self.split(rank) is not None:
                reachable[token] = rank
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        for token, rank in reachable.items():
            for n in range(len(token) - 1, 0, -1):
                if (r := reachable.get(token[:n])) is not None:
                    self.shorter[rank] = r
                    break
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def split(self, rank: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token joins; None for single bytes and for tokens out of reach."""
        if rank not in self.halves:
            token = self.bytes_of[rank]
            parts = merge(token, self.ranks, rank) if len(token) > 1 else []
            self.halves[rank] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[rank]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives back the two.

        Undoes merges from the latest one back, on either side of the border, and asks at each step whether the two
        tokens then touching would have been joined before the merge just undone.
        """
        if len(self.pairs) >= PAIR_MEMORY:
            self.pairs.clear()
        known = self.pairs[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        ranks, name = self.ranks, self.bytes_of
        undone = 1 << 60  # rank of the merge that was undone last; joins from then on need a lower rank
        strict = True  # a tie in rank goes to the merge further left: the border is left of what the right side undoes
        while True:
            joined = ranks.get(name[left] + name[right])
            if joined is not None and (joined < undone or (joined == undone and not strict)):
                return False
            a, b = self.halves.get(left), self.halves.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                undone, strict, left = left, True, a[1]
            else:  # of one token on both sides the left was merged first, so the right one is undone first
                undone, strict, right = right, False, b[0]

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(word)
        if whole is not None:
            return (whole,)
        size_of, shorter, pairs = self.size_of, self.shorter, self.pairs
        n = len(word)
        longest: list[int | None] = [None] * n
        # matches come by their ends, the later of two from one place being the longer
        for end, rank in self.automaton.iter(word.decode("latin-1")):
            longest[end - size_of[rank] + 1] = rank
        open_places = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token, last = 0, longest[0], None
        while True:
            while token is not None:
                end = at + size_of[token]
                if open_places[end]:
                    if last is None:
                        break
                    fits = pairs.get((last, token))
                    if fits or fits is None and self.compatible(last, token):
                        break
                token = shorter.get(token)
            if token is not None:
                out.append(token)
                if end == n:
                    return tuple(out)
                at, last, token = end, token, longest[end]
            else:  # nothing fits here: this place is closed, and the token that led to it is shortened
                open_places[at] = 0
                token = out.pop()
                at -= size_of[token]
                last = out[-1] if out else None

    def encode(self, text: str, find: Callable[[str], list[str]]) -> list[int]:
        """Ids of a whole text, each match of the pattern by itself."""
        out: list[int] = []
        words = self.words
        for w in find(text):
            ids = words.get(w)
            if ids is None:
                ids = self.encode_word(w.encode())
                if len(words) >= WORD_MEMORY:
                    words.clear()
                if len(w) <= 64:
                    words[w] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids; raises KeyError for an id outside the vocabulary."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> BacktrackingBPE:
    """One codec a worker process and vocabulary."""
    return BacktrackingBPE(read_ranks(path))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids`` (array<int>) of every whole text; null and empty texts give an empty array.

    Other columns are ignored; an empty table gives no rows; repeated ids give a row each. Surrogates do not occur in
    Spark strings. No shuffle: each task encodes its own rows, with bounded memories of words and pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        bpe, find = codec(ranks_path), regex.compile(pattern).findall
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.encode(text or "", find) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, bytes`` of every row's ids; null ids give empty bytes, an id outside the vocabulary is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path)
        for batch in batches:
            out = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: digests of a text's ids and of the bytes they decode to.

    As ``encode`` followed by ``decode`` in one pass over each batch, so that ids do not travel back and forth.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        bpe, find = codec(ranks_path), regex.compile(pattern).findall
        digits = {r: str(r) for r in bpe.bytes_of}.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: tuple[list, list, list] = ([], [], [])
                for text in part.column(1).to_pylist():
                    ids = bpe.encode(text or "", find)
                    out[0].append(len(ids))
                    out[1].append(hashlib.sha256(",".join(map(digits, ids)).encode()).hexdigest())
                    out[2].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
