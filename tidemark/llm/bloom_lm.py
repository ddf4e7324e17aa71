"""Language-model scoring with a log-frequency Bloom filter of quantised bigram counts.

Documents are dealt into blocks of about equal bytes by a hash of id and text. Each block names its distinct words and
bigrams once; shards of words and bigrams add up the counts of all blocks, hand every block the exact counts of its own
words, and hold their bigrams' counts, quantised to powers of two, as one segment of a log-frequency Bloom filter: a bigram
counted c times is entered at the levels 1 to 1 + floor(log2 c), and is read back by probing level after level up to the
first miss.
The filter is broadcast in slices of checked size and the documents are scored once a slice; one slice is the rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable

#: Filter bits an entry and probes an entry: about 1 % of absent bigrams are taken for seen once.
BITS, PROBES = 10, 5
#: Share of a bigram's probability left to its second word alone.
BACKOFF = 0.4
#: Bytes of text in a block, about.
BLOCK = 8 << 20
#: Bytes of a bigram's key within its shard.
KEY = 5
#: Ends of a text as second and first word of a bigram.
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bigram_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


def in_shards(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each key, and what tells it there: 40 bits of the rest."""
    return (keys % np.uint64(shards)).astype(np.int64), (keys // np.uint64(shards)) & np.uint64((1 << 8 * KEY) - 1)


def packed(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEY, 8), np.uint8)
    out[:, :KEY] = np.frombuffer(raw, np.uint8).reshape(-1, KEY)
    return out.view("<u8").ravel()


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lowered: runs of bytes other than ASCII white space."""
    return (text or "").encode().lower().split()


def held_out(id_col: str) -> Column:
    """Whether a document is kept from training; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


class Words:
    """Numbers for the distinct words of a block, and their hashes."""

    def __init__(self):
        self.number: dict[bytes, int] = {}

    def ids(self, text: str | None) -> np.ndarray:
        number = self.number
        return np.asarray([number.setdefault(w, len(number)) for w in tokens(text)], dtype=np.int32)

    def hashes(self) -> np.ndarray:
        from xxhash import xxh64_intdigest

        return np.fromiter((xxh64_intdigest(w, 17) for w in self.number), dtype=np.uint64, count=len(self.number))


def level(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c), 1 for counts of one."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


LOW = np.uint64(0xFFFFFFFF)


def probe_places(keys: np.ndarray, at_level: int, size: np.ndarray | np.uint64) -> Iterator[np.ndarray]:
    """Places of the probes for entries (key, level) in segments of ``size`` bits, fewer than 2**32."""
    entry = mix(keys + np.uint64(at_level * 0xD1342543DE82EF95 % (1 << 64)))
    place, step = entry & LOW, (entry >> np.uint64(33)) | np.uint64(1)
    for _ in range(PROBES):
        yield (place * size) >> np.uint64(32)
        place = (place + step) & LOW


def build_segment(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A segment of the filter: its bits, eight to a byte; at least 64 bits."""
    levels = level(counts)
    size = (int(levels.sum()) * BITS // 64 + 1) * 64
    bits = np.zeros(size, dtype=bool)
    for j in range(1, int(levels.max(initial=0)) + 1):
        for place in probe_places(keys[levels >= j], j, np.uint64(size)):
            bits[place] = True
    return np.packbits(bits, bitorder="little").tobytes()


def laid_out(segments: dict[int, bytes], total: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Segments end to end, with the size and the place in bits of each of ``total`` shards; size 0 for those not held."""
    size, base, at = np.zeros(total, dtype=np.uint64), np.zeros(total, dtype=np.uint64), 0
    for s, b in segments.items():
        size[s], base[s] = 8 * len(b), at
        at += 8 * len(b)
    return size, base, b"".join(segments.values())


class Filter:
    """Segments of the filter as ``laid_out``; the bytes are used where they are."""

    def __init__(self, size: np.ndarray, base: np.ndarray, bits: bytes):
        self.size, self.base, self.bits = size, base, np.frombuffer(bits, dtype=np.uint8)

    def holds(self, shard: np.ndarray) -> np.ndarray:
        return self.size[shard] > 0

    def levels(self, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """The level read back for each key; its shard must be held."""
        out = np.zeros(len(keys), dtype=np.int64)
        left, base, size = np.arange(len(keys)), self.base[shard], self.size[shard]
        j = 0
        while len(left):
            j += 1
            there = np.ones(len(left), dtype=bool)
            for place in probe_places(keys[left], j, size):
                place += base
                there &= (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            left, base, size = left[there], base[there], size[there]
            out[left] = j
        return out


def typical_count(levels: np.ndarray) -> np.ndarray:
    """The count that stands for a level: the middle of the counts it covers, 0 for level 0."""
    return np.where(levels > 0, 0.75 * np.exp2(levels) - 0.5, 0.0)


def _in_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    size = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("int")
    # ids go as text, which holds a null where pandas would make numbers of another kind
    return docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"), block.alias("_block"), held_out(id_col).alias("_held")), blocks


def _gather(blocked: DataFrame, shards: int) -> DataFrame:
    """Per shard and block the words with their training counts, and the training bigrams with theirs."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        words, trained, lone = Words(), [], []
        for held, text in zip(block["_held"], block["_text"], strict=True):
            ids = words.ids(text)
            if not held:
                trained.append(ids)
        hashes = words.hashes()
        counts = np.bincount(np.concatenate([*trained, np.empty(0, np.int32)]), minlength=len(hashes)).astype("<i8")
        for ids in trained:
            h = hashes[ids]
            lone.append(bigram_keys(np.append(START, h), np.append(h, END)))
        keys, seen = np.unique(np.concatenate([*lone, np.empty(0, np.uint64)]), return_counts=True)
        by_word, (by_key, keys) = (hashes % np.uint64(shards)).astype(int), in_shards(keys, shards)
        order, names, key_order = np.argsort(by_word, kind="stable"), np.array([*words.number, None], dtype=object)[:-1], np.argsort(by_key, kind="stable")
        w_cut, k_cut = np.searchsorted(by_word[order], np.arange(shards + 1)), np.searchsorted(by_key[key_order], np.arange(shards + 1))
        rows = []
        for s in range(shards):
            w, k = order[w_cut[s] : w_cut[s + 1]], key_order[k_cut[s] : k_cut[s + 1]]
            if not len(w) and not len(k):
                continue  # with very many shards a block has nothing for most of them
            many = np.flatnonzero(seen[k] > 1)
            rows.append((s, int(block["_block"].iloc[0]), b"\n".join(names[w]), counts[w].tobytes(), packed(keys[k]), many.astype("<u4").tobytes(), seen[k][many].astype("<i8").tobytes()))
        return pd.DataFrame(rows, columns=["_shard", "block", "words", "counts", "keys", "many", "seen"])

    return blocked.groupBy("_block").applyInPandas(run, "_shard int, block int, words binary, counts binary, keys binary, many binary, seen binary")


def _total(gathered: DataFrame) -> DataFrame:
    """Per shard: each block's words with their counts over all blocks, and one row (block -1) with the filter's segment."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        total: dict[bytes, int] = {}
        keys, seen = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for r in part.itertuples(index=False):
            if r.counts:
                for w, n in zip(r.words.split(b"\n"), np.frombuffer(r.counts, "<i8").tolist(), strict=True):
                    total[w] = total.get(w, 0) + n
            k = unpacked(r.keys)
            n = np.ones(len(k), np.int64)
            n[np.frombuffer(r.many, "<u4")] = np.frombuffer(r.seen, "<i8")
            keys.append(k)
            seen.append(n)
        all_keys, all_seen = np.concatenate(keys), np.concatenate(seen)
        order = np.argsort(all_keys)
        all_keys, all_seen = all_keys[order], all_seen[order]
        first = np.flatnonzero(np.append(True, all_keys[1:] != all_keys[:-1])[: len(all_keys)])
        bits = build_segment(all_keys[first], np.add.reduceat(all_seen, first) if len(first) else all_seen)
        shard = int(part["_shard"].iloc[0])
        rows = [(-1, shard, b"", b"", bits, sum(total.values()), sum(n > 0 for n in total.values()))]
        for r in part.itertuples(index=False):
            if r.counts:
                back = np.fromiter((total[w] for w in r.words.split(b"\n")), dtype="<i8")
                rows.append((r.block, shard, r.words, back.tobytes(), b"", 0, 0))
        return pd.DataFrame(rows, columns=["_block", "_shard", "words", "counts", "bits", "n_tokens", "n_words"])

    return gathered.groupBy("_shard").applyInPandas(run, "_block int, _shard int, words binary, counts binary, bits binary, n_tokens long, n_words long")


def _score_block(docs: pd.DataFrame, counted: pd.DataFrame, held: Filter, shards: int, n_tokens: int, n_words: int, n_texts: int, whole: bool) -> pd.DataFrame:
    """``_row, _id, held_out, n_tokens, n_known, base_score, score`` of a block; without ``whole`` only the slice's bigrams are scored.

    Rows are numbered in the order of id and text, so those of several slices are told to be the same; rows that repeat
    both have the same scores.
    """
    docs = docs.sort_values(["_id", "_text"], ignore_index=True)
    count_of: dict[bytes, int] = {}
    for words, counts in zip(counted["words"], counted["counts"], strict=True):
        count_of.update(zip(words.split(b"\n"), np.frombuffer(counts, "<i8").tolist(), strict=True))
    words = Words()
    words.number = {w: i for i, w in enumerate(count_of)}
    counts, hashes = np.fromiter(count_of.values(), np.int64, len(count_of)), words.hashes()
    everything = n_tokens + n_words + 1
    out: list[list] = [[] for _ in range(4)]

    def flush(texts: list[np.ndarray]) -> None:
        """Some texts at once: tokens laid end to end, an end after each text."""
        sizes = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
        ends = np.cumsum(sizes) - 1
        inner = np.ones(int(sizes.sum()), dtype=bool)
        inner[ends] = False
        ids = np.concatenate(texts)
        h, c = np.full(len(inner), END), np.full(len(inner), n_texts, np.int64)
        h[inner], c[inner] = hashes[ids], counts[ids]
        first, before = np.append(START, h[:-1]), np.append(n_texts, c[:-1])
        first[ends[:-1] + 1], before[ends[:-1] + 1] = START, n_texts
        alone = (c + 1.0) / everything
        bigrams = bigram_keys(first, h)
        shard, bigrams = in_shards(bigrams, shards)
        mine = np.flatnonzero(held.holds(shard))
        seen = np.minimum(typical_count(held.levels(bigrams[mine], shard[mine])), np.minimum(before[mine], c[mine]))
        p = np.where(before[mine] > 0, (1 - BACKOFF) * seen / np.maximum(before[mine], 1) + BACKOFF * alone[mine], alone[mine])
        logs = np.zeros(len(inner))
        logs[mine] = np.log10(p)
        begins = ends - sizes + 1
        for values, name in zip((sizes, np.add.reduceat((c > 0).astype(np.int64), begins), np.add.reduceat(np.log10(alone), begins) * whole, np.add.reduceat(logs, begins)), out, strict=True):
            name.append(values)

    texts, size = [], 0
    for text in docs["_text"]:
        texts.append(words.ids(text))
        size += len(texts[-1]) + 1
        if size > 200_000:
            flush(texts)
            texts, size = [], 0
    if texts:
        flush(texts)
    columns = [np.concatenate(x) if x else np.empty(0) for x in out]
    return pd.DataFrame({"_block": docs["_block"], "_row": np.arange(len(docs)), "_id": docs["_id"], "held_out": docs["_held"], "n_tokens": columns[0], "n_known": columns[1], "base_score": columns[2], "score": columns[3]})


def _scorer(shared, shards: int, n_tokens: int, n_words: int, n_texts: int, whole: bool):
    """The function over a block's documents and counts for one broadcast slice of the filter."""

    def run(docs: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        return _score_block(docs, counted, Filter(*shared.value), shards, n_tokens, n_words, n_texts, whole)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK, slice_bytes: int = 128 << 20) -> DataFrame:
    """One row per document: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from documents whose crc32(id) mod 7 is not 2. Tokens are words (A-Z lowered) and one end. ``base_score`` adds
    log10 of exact add-one unigram probabilities; ``score`` of 0.6 * c(a b)/c(a) + 0.4 * P(b), the bigram count read
    back from the filter and never above the exact counts of its words; after an unseen word P(b) alone. Null and empty
    texts have the end alone; an empty table gives no rows; repeated ids are separate documents and train as such; other columns are ignored. Blocks hold
    about ``block_bytes`` of text; the shards are as many as the blocks. The filter grows with the training text; no more
    than ``slice_bytes`` of it is collected and broadcast at a time, and the documents are scored again for every further
    slice.
    """
    spark = docs.sparkSession
    blocked, blocks = _in_blocks(docs, id_col, text_col, block_bytes)
    shards = max(8, blocks)
    totals = durable(_total(_gather(blocked, shards)))
    segments = totals.where("_block = -1")
    n_tokens, n_words = segments.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    n_texts = docs.where(~held_out(id_col)).count()
    n_tokens, n_words = n_tokens + n_texts, n_words + (n_texts > 0)
    counted = totals.where("_block >= 0").select(F.col("_block").alias("_in"), "words", "counts")
    sizes = [(r[0], r[1]) for r in segments.select("_shard", F.octet_length("bits")).collect()]  # two numbers a shard
    slices: list[list[int]] = [[]]
    room = slice_bytes
    for shard, size in sorted(sizes):
        if size > room and slices[-1]:
            slices.append([])
            room = slice_bytes
        slices[-1].append(shard)
        room -= size
    id_type = docs.schema[id_col].dataType.simpleString()
    kinds = "_block int, _row long, _id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = None
    for number, shard_list in enumerate(slices):
        held = {r[0]: bytes(r[1]) for r in segments.where(F.col("_shard").isin(shard_list)).select("_shard", "bits").toLocalIterator()}
        if number == 0:  # shards that no block has anything for hold an empty segment
            held |= {n: bytes(8) for n in set(range(shards)) - {n for n, _ in sizes}}
        shared = spark.sparkContext.broadcast(laid_out(held, shards))
        scorer = _scorer(shared, shards, n_tokens, n_words, n_texts, number == 0)
        part = blocked.groupBy("_block").cogroup(counted.groupBy("_in")).applyInPandas(scorer, kinds)
        out = part if out is None else out.unionByName(part)
    if len(slices) > 1:
        same = [F.first(c).alias(c) for c in ("_id", "held_out", "n_tokens", "n_known")]
        out = out.groupBy("_block", "_row").agg(*same, F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
    return out.select(F.col("_id").cast(id_type).alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
