"""Removal of repeated passages: paragraph MinHash banding.

A paragraph is what lies between line breaks and sentence ends; sentences of fewer than five words go with the next one, and a
paragraph of more than ``LONG`` words is cut again behind words chosen by the hash of the two last words, so that equal
content is cut alike wherever it stands. Paragraphs get a MinHash signature of their five-word shingles. Paragraphs that agree
in a band are candidates, each with each; the exact Jaccard similarity of their shingles decides; links are followed to
components, and of each component's occurrences the first one stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import components, durable, join_spread
from tidemark.llm.suffix_dedup import BASES, Names, _mix, _narrowed

#: Words of a shingle; least similarity; bands of two rows each: a pair at 0.8 meets in one with 1 - 0.36**4 = 98.3 %.
SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 4, 2
#: Words above which a paragraph is cut behind words of its own.
LONG = 64
#: Words that removed paragraphs in a row must have at least to be removed.
LEAST_RUN = 13
#: Distinct paragraphs that a task remembers to have sent.
SENT = 1_000_000
#: Paragraphs of a crowded bucket on one side of a comparison, and shingles that are compared at a time.
TILE, COLUMNS = 512, 4096

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MINS = np.random.default_rng(17).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Paragraphs:
    """The words of a text and the paragraphs that they make: ``first`` word and ``size`` of each."""

    def __init__(self, text: str | None):
        raw = (text or "").encode().lower()
        x = np.frombuffer(raw, np.uint8)
        inside = ~_SPACE[x]
        start, stop = np.flatnonzero(inside & np.append(True, ~inside[:-1])[: len(x)]), np.flatnonzero(inside & np.append(~inside[1:], True)[: len(x)]) + 1
        self.n = len(start)
        self.first = self.size = np.empty(0, np.int64)
        if not self.n:
            return
        self.joined, self.sums = b" ".join(raw.split()), {}
        self.ends = np.cumsum(stop - start + 1) - 1
        self.starts = np.append(0, self.ends[:-1] + 1)
        last, lines = _ENDS[x[stop - 1]], np.cumsum(x == 10)[start]
        last[:-1] |= lines[1:] != lines[:-1]
        size = self._without_short(last)
        in_long = np.repeat(size > LONG, size)
        if in_long.any():  # two words decide, so that the cuts fall anywhere in a small vocabulary too
            last[1:] |= in_long[1:] & (self.name(np.arange(self.n - 1), 2) % np.uint64(12) == 0)
            size = self._without_short(last)
        self.first, self.size = np.cumsum(size) - size, size

    @staticmethod
    def _without_short(last: np.ndarray) -> np.ndarray:
        """Takes the ends of pieces of fewer than ``SHINGLE`` words from ``last``, but for the text's; the sizes then."""
        last[-1] = True
        stop = np.flatnonzero(last)
        last[stop[np.diff(np.append(-1, stop)) < SHINGLE]] = False
        last[-1] = True
        return np.diff(np.append(-1, np.flatnonzero(last)))

    def name(self, first: np.ndarray, size, which: int = 0) -> np.ndarray:
        """Fingerprints of runs of words."""
        if which not in self.sums:
            base, names = BASES[which], Names(self.joined)
            names.at(np.empty(0, np.int64), 0, base)
            self.sums[which] = names.sums[base], Names.powers_of(base, len(self.joined) + 1)[1]
        total, down = self.sums[which]
        a, b = self.starts[first], self.ends[first + size - 1]
        return _mix((total[b] - total[a]) * down[a])

    def shingles(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of the shingles of some paragraphs (each of ``SHINGLE`` words or more), and where each one's begin."""
        count = self.size[some] - SHINGLE + 1
        begin = np.cumsum(count) - count
        at = np.arange(int(count.sum())) - np.repeat(begin - self.first[some], count)
        return self.name(at, SHINGLE), begin


def signature(shingles: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Values of the bands of paragraphs whose shingles are laid end to end: two MinHash values and the band's number."""
    if not len(begin):
        return np.empty((BANDS, 0), np.uint64)
    mixed = _mix(shingles ^ np.uint64(0xA24BAED4963EE407))
    least = [np.minimum.reduceat(mixed * m, begin) for m in _MINS]
    return np.stack([_mix(_mix(least[ROWS * k]) + least[ROWS * k + 1] + np.uint64(k)) for k in range(BANDS)])


def _columns(part: pa.RecordBatch, which: list[np.ndarray], names: list[str], columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    arrays = [np.concatenate(c) for c in columns]
    return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate(which))), *(pa.array(a.view(np.int64) if a.dtype == np.uint64 else a) for a in arrays)], names=names)


def _all_paragraphs(base: DataFrame) -> DataFrame:
    """``_k1, _k2, no, h, g, later``: number and 128-bit name of every paragraph that has a shingle.

    ``later`` marks those that have an equal one before them (by key and number) among the rows worked on at a time. They
    need no rank and have names of their own, so of a paragraph that is everywhere one row for 5,000 documents meets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                which, cols = [], [[], [], []]
                for i, text in enumerate(part.column(2).to_pylist()):
                    p = Paragraphs(text)
                    some = np.flatnonzero(p.size >= SHINGLE)
                    if len(some):
                        which.append(np.full(len(some), i))
                        for c, v in zip(cols, (some.astype(np.int32), p.name(p.first[some], p.size[some]), p.name(p.first[some], p.size[some], 1)), strict=True):
                            c.append(v)
                if which:
                    row, no, h, g = (np.concatenate(c) for c in (which, *cols))
                    k1, k2 = (part.column(c).to_numpy()[row] for c in range(2))
                    order = np.lexsort((no, k2, k1, g, h))
                    new = np.append(True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1]))
                    first = np.empty(len(h), np.int64)
                    first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
                    later = (k1 != k1[first]) | (k2 != k2[first]) | (no != no[first])  # repeated rows are one document
                    own = _mix(k1.view(np.uint64) ^ _mix(k2.view(np.uint64) + no.astype(np.uint64)))
                    h, g = np.where(later, own, h), np.where(later, ~own, g)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, no, h.view(np.int64), g.view(np.int64), later)], names=["_k1", "_k2", "no", "h", "g", "later"])

    return base.mapInArrow(run, "_k1 long, _k2 long, no int, h long, g long, later boolean")


def _banded(base: DataFrame) -> DataFrame:
    """``_key, no, h, band``: for every distinct paragraph that a task meets, each band's MinHash value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                which, cols = [], [[], [], []]
                for i, text in enumerate(part.column(1).to_pylist()):
                    p = Paragraphs(text)
                    some = np.flatnonzero(p.size >= SHINGLE)
                    if not len(some):
                        continue
                    h = p.name(p.first[some], p.size[some])
                    fresh = []
                    for k, v in enumerate(h.tolist()):
                        if v not in sent:
                            sent.add(v)
                            fresh.append(k)
                    if not fresh:
                        continue
                    some, h = some[fresh], h[fresh]
                    bands = signature(*p.shingles(some))
                    for row in bands:
                        which.append(np.full(len(some), i))
                        for c, v in zip(cols, (some.astype(np.int32), h, row), strict=True):
                            c.append(v)
                if len(sent) > SENT:
                    sent.clear()
                if which:
                    yield _columns(part, which, ["_key", "no", "h", "band"], cols)

    return base.mapInArrow(run, "_key long, no int, h long, band long")


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """``h, g, set``: name and distinct shingles of the paragraphs that ``wanted`` numbers; ``texts`` has ``_text`` and ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                h, g, sets = [], [], []
                for text, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    p = Paragraphs(text)
                    some = np.unique(wanted)
                    some = some[some < len(p.size)]  # a number of another text under the same 64-bit key
                    some = some[p.size[some] >= SHINGLE]
                    if not len(some):
                        continue
                    x, begin = p.shingles(some)
                    for names, which in ((h, 0), (g, 1)):
                        names += p.name(p.first[some], p.size[some], which).view(np.int64).tolist()
                    sets += [np.unique(s).view(np.int64) for s in np.split(x, begin[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["h", "g", "set"])

    return texts.select("_text", "wanted").mapInArrow(run, "h long, g long, set array<long>")


def similar_in(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links ``i, j`` that join all sets whose Jaccard similarity reaches the threshold, as a spanning forest of these pairs."""
    n, size = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    word, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    # shingles of one set alone are shared by no pair
    common = np.flatnonzero(np.bincount(at, minlength=len(word)) > 1)
    column = np.full(len(word), -1)
    column[common] = np.arange(len(common))
    column = column[at]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((n, n), np.float32)
    for begin in range(0, len(common), COLUMNS):
        lo, hi = np.searchsorted(column, [begin, begin + COLUMNS])
        held = np.zeros((n, min(COLUMNS, len(common) - begin)), np.float32)
        held[row[lo:hi], column[lo:hi] - begin] = 1
        shared += held @ held.T
    linked = shared >= SIMILAR * (size[:, None] + size[None, :] - shared.astype(np.float64))
    left, a, b = np.ones(n, bool), [], []
    for root in range(n):
        todo = [root] if left[root] else []
        left[root] = False
        while todo:
            i = todo.pop()
            found = np.flatnonzero(linked[i] & left)
            left[found] = False
            a += [i] * len(found)
            b += found.tolist()
            todo += found.tolist()
    return np.asarray(a, np.int64), np.asarray(b, np.int64)


def _links(members: DataFrame) -> DataFrame:
    """``a, b``: links among the members (``h, set``) of each block (``band, row, col``); a block is held by one task."""

    def within(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        h, sets = block.column(3).to_numpy(), block.column(4)
        ends, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
        i, j = similar_in([flat[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)])
        return h[i], h[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            whole = table.to_batches()[0]
            key = np.stack([whole.column(k).to_numpy() for k in range(3)])
            cut = np.append(0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1)
            found = [within(whole.slice(x, y - x)) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if y - x > 1]
            rest = whole.slice(int(cut[-1]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["a", "b"])
        if rest is not None and rest.num_rows > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in within(rest)], names=["a", "b"])

    dealt = members.select("band", "row", "col", "h", "set").repartition("band", "row", "col").sortWithinPartitions("band", "row", "col")
    return dealt.mapInArrow(run, "a long, b long")


def similar_paragraphs(base: DataFrame, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """``a, b``: names of different paragraphs whose shingles' Jaccard similarity reaches the threshold; and ``h, g``, both names of each.

    ``base`` has ``_key`` and ``_text``. All pairs of a band's bucket are compared, and links that connect the similar ones are returned. Members of a bucket
    are dealt into tiles of about ``tile`` by a hash and each two tiles are compared in a task of their own, so that no
    bucket meets in one task, however many it holds.
    """
    bucket = W.partitionBy("band")
    met = _banded(base).repartition("band").groupBy("band", "h").agg(F.min(F.struct("_key", "no")).alias("x"))
    met = durable(met.withColumn("_n", F.count("*").over(bucket)).where("_n > 1"))
    places = met.groupBy("h").agg(F.min("x").alias("x"))
    wanted = durable(places.groupBy(F.col("x._key").alias("_key")).agg(F.collect_list("x.no").alias("wanted")))
    sets = durable(_shingle_sets(_narrowed(base, wanted)).dropDuplicates(["h"]))
    tiles = F.ceil(F.col("_n") / tile).cast("int")
    dealt = met.select("band", "h", tiles.alias("_tiles"), F.pmod(F.xxhash64("h"), tiles).cast("int").alias("_tile"))
    others = F.filter(F.sequence(F.lit(0), F.col("_tiles") - 1), lambda t: (t != F.col("_tile")) | (F.col("_tiles") == 1))
    spread = dealt.select("band", "h", "_tile", F.explode(others).alias("_with"))
    blocks = spread.select("band", "h", F.least("_tile", "_with").alias("row"), F.greatest("_tile", "_with").alias("col"))
    return _links(blocks.join(sets.select("h", "set"), "h")).distinct(), sets.select("h", "g")


def cut_text(text: str, numbers: list[int], least_run: int = LEAST_RUN) -> tuple[str, int, int]:
    """The text without the numbered paragraphs, where those in a row have ``least_run`` words; how many went, and words."""
    p = Paragraphs(text)
    gone = np.zeros(len(p.size), bool)
    gone[numbers] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
    raw = text.encode()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    kept, at, paragraphs, words = [], 0, 0, 0
    for a, b in edge.tolist():
        n = int(p.size[a:b].sum())
        if n < least_run:
            continue
        start = spans[p.first[a]][0]
        stop = spans[p.first[b]][0] if b < len(p.first) else len(raw)
        kept.append(raw[at:start])
        at, paragraphs, words = stop, paragraphs + b - a, words + n
    return b"".join([*kept, raw[at:]]).decode(), paragraphs, words


def repeated(base: DataFrame) -> DataFrame:
    """``_k1, _k2, numbers``: the paragraphs to remove from each document that has any; ``base`` has ``_k1, _k2, _text``.

    Of equal paragraphs all but the first go, of those in one component all but the first of all; the first one of a name
    or a component is a minimum of partial minima. Names count as equal if all of their 128 bits are.
    """
    links, names = similar_paragraphs(base.select(F.col("_k1").alias("_key"), "_text"))
    found = components(links.select("a", "b")).join(names, F.col("node") == F.col("h")).select("h", "g", "component")
    me = F.struct("_k1", "_k2", "no")
    rows = _all_paragraphs(base).withColumn("_first", F.min(me).over(W.partitionBy("h", "g")))
    rows = rows.join(found, ["h", "g"], "left").withColumn("_again", F.col("later") | (me != F.col("_first")))
    marked = durable(rows.where("_again or component is not null").select("_k1", "_k2", "no", "component"))
    similar = marked.where("component is not null")
    first = durable(similar.groupBy("component").agg(F.min(me).alias("_first"), F.count("*").alias("_n")))
    total = first.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    others = join_spread(similar, first, ["component"], "_n", total).where(me != F.col("_first"))
    gone = marked.where("component is null").select("_k1", "_k2", "no").unionByName(others.select("_k1", "_k2", "no"))
    return gone.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set("no")).alias("numbers"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_run: int = LEAST_RUN) -> DataFrame:
    """``docs``, all rows and columns, with repeated passages cut out of ``text_col``, and ``n_removed`` (paragraphs) and ``removed_words``.

    The occurrence that stays is the one whose document's id and text hash to the smallest value, and the first in it.
    A last sentence of fewer than five words is left alone, as are removed paragraphs in a row of fewer than ``least_run``
    words. Null and empty texts stay as they are; of rows that repeat id and text each is cut alike, as one document; an
    empty table gives no rows; other columns may have any names but ``n_removed`` and ``removed_words``.
    """
    rest = [c for c in docs.columns if c != text_col]
    text = F.col(f"`{text_col}`")
    keys = [F.xxhash64(F.col(f"`{id_col}`"), text).alias("_k1"), F.xxhash64(F.lit("2"), text, F.col(f"`{id_col}`")).alias("_k2")]
    keyed = docs.select(*keys, F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).alias("_rest"), text.alias("_text"))
    numbers = durable(repeated(keyed.select("_k1", "_k2", "_text").where("_text is not null")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [cut_text(t, n, least_run) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], names=["_rest", "_text", "n_removed", "removed_words"])

    joined = keyed.join(numbers, ["_k1", "_k2"], "left").select("_rest", "_text", "numbers")
    touched = joined.where("numbers is not null")
    kind = touched.schema["_rest"].dataType.simpleString()
    cut = touched.mapInArrow(run, f"_rest {kind}, _text string, n_removed long, removed_words long")
    zero = F.lit(0).cast("long")
    whole = joined.where("numbers is null").select("_rest", "_text", zero.alias("n_removed"), zero.alias("removed_words"))
    places = {c: f"_rest.c{i}" for i, c in enumerate(rest)} | {text_col: "_text"}
    return whole.unionByName(cut).select(*[F.col(places[c]).alias(c) for c in docs.columns], "n_removed", "removed_words")
