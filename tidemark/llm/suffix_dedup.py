"""Removal of byte strings that start at two places or more, by prefix doubling over sampled positions.

Positions are ranked by the name of the bytes that start there; survivors are ranked again by pairs of their rank and the
name of further bytes, at lengths that go from 72 by half of what is left to the threshold of 200: 136, 168, 184, ... Those
that are unique drop out. Ranks are only compared for being equal, so a rank is a hash and a shuffle with counts stands for
the sort.

1. *Anchors.* In the first round a position takes part only if it has the least name among those of some string of
   threshold length. Which position of a string that is depends on the string's bytes alone, so equal strings hold equal
   anchors at equal places. Anchors whose name is unique drop out, and with them all strings that they stand for.
2. *Doubling.* The strings around an anchor are told by how many bytes they have before it: 0 to 128. In every further
   round a range of these is halved. What all strings of a half share is its core, longer than before: cores that are
   unique drop out. If all bytes that the strings of a half cover are repeated as a whole, all of them are, and the half is
   settled. Rounds end with single strings.

Anchors of one name are few as a rule, and go through the rounds of step 2 within one task; those of crowded names go
through the same rounds as Spark joins, so that no group meets in one task.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import durable, join_spread

#: Odd bases of the two names.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: A name is frequent if it occurs more often than once in so many documents.
FREQUENT = 512
#: Occurrences of a name from which it is crowded at any rate, and below which it is not.
CROWDED, NOT_CROWDED = 20_000, 1000
#: Distinct surroundings that a task merges before it sends them, and that it solves at a time.
MERGED, SOLVED = 60_000, 20_000
#: Where an anchor is: two halves of its document's 128-bit key, and the place.
MEMBER, MEMBER_SIZE = "<qqi", struct.calcsize("<qqi")
MEMBERS = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("place", "<i4")])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Names:
    """Names of the strings of a document at any length, each from a difference of prefix sums modulo 2**64."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, raw: bytes):
        self.raw = np.frombuffer(raw, np.uint8)
        self.sums: dict[int, np.ndarray] = {}

    @classmethod
    def powers_of(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        held = cls.powers.get(base)
        if held is None or len(held[0]) < n:
            size = 1 << max(16, (n - 1).bit_length())
            up, down = np.full(size, np.uint64(base)), np.full(size, np.uint64(pow(base, -1, 1 << 64)))
            up[0] = down[0] = 1
            held = np.multiply.accumulate(up), np.multiply.accumulate(down)
            if n <= 1 << 22:  # tables for very long texts are not kept
                cls.powers[base] = held
        return held

    def at(self, starts: np.ndarray | slice, length: int, base: int = BASES[0]) -> np.ndarray:
        """Names of the strings of ``length`` bytes from ``starts`` on."""
        up, down = self.powers_of(base, len(self.raw) + 1)
        if base not in self.sums:
            total = np.zeros(len(self.raw) + 1, np.uint64)
            np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * up[: len(self.raw)], out=total[1:])
            self.sums[base] = total
        total = self.sums[base]
        if isinstance(starts, slice):
            n = len(self.raw) - length + 1
            return _mix((total[length : length + n] - total[:n]) * down[:n])
        return _mix((total[starts + length] - total[starts]) * down[starts])


def window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    m, span = x, 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = width - span
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def anchors(names: Names, length: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions, ascending, that have the least name at ``length`` in some string of threshold length; and those names."""
    if len(names.raw) < threshold:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    x = names.at(slice(None), length)
    width = threshold - length + 1
    pad = np.zeros(width - 1, np.uint64)
    highest = ~window_minimum(~np.concatenate([pad, window_minimum(x, width), pad]), width)
    at = np.flatnonzero(x == highest)
    return at, x[at]


def _prefix_names(side: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the names of its first 0, 1, ... ``width`` bytes, and how many bytes it has."""
    size = np.fromiter(map(len, side), np.int64, len(side))
    flat = np.zeros((len(side), width), np.uint64)
    flat[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(side), np.uint8).astype(np.uint64) + np.uint64(1)
    up, _ = Names.powers_of(BASES[1], width + 1)
    out = np.zeros((len(side), width + 1), np.uint64)
    np.cumsum(flat * up[:width], axis=1, out=out[:, 1:])
    return _mix(out), size


def solve(group: np.ndarray, before: list[bytes], after: list[bytes], asks: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """How far before and after its anchor the bytes of each row are to be removed; -1 and -1 for not at all.

    A row is a distinct surrounding of an anchor; ``group`` is the anchor's name. Rows that ``asks`` leaves out have their
    answer and are only there for others to be equal to. Equal names of covered bytes are compared byte for byte.
    """
    left, left_size = _prefix_names([x[::-1] for x in before], width)
    right, right_size = _prefix_names(after, width)
    most_left, most_right = np.full(len(group), -1), np.full(len(group), -1)
    row, lo, hi, ask = np.arange(len(group)), np.zeros(len(group), np.int64), np.full(len(group), width), asks.copy()
    while len(row):
        middle = (lo + hi) >> 1
        row, ask = np.concatenate([row, row]), np.concatenate([ask, ask])
        lo, hi = np.concatenate([lo, middle + 1]), np.concatenate([middle, hi])
        real = (lo <= hi) & (np.maximum(lo, width - right_size[row]) <= np.minimum(hi, left_size[row]))
        row, lo, hi, ask = row[real], lo[real], hi[real], ask[real]
        core = _mix(_mix(group[row] ^ left[row, lo]) + right[row, width - hi] + lo.astype(np.uint64))
        cover = _mix(_mix(group[row] ^ left[row, hi]) + right[row, width - lo] + lo.astype(np.uint64))
        whole = (hi <= left_size[row]) & (width - lo <= right_size[row])
        order = np.lexsort((cover, whole, core))
        row, lo, hi, ask, core, cover, whole = (x[order] for x in (row, lo, hi, ask, core, cover, whole))
        new = np.append(True, core[1:] != core[:-1])[: len(row)]
        new_cover = new | ~whole | np.append(True, (cover[1:] != cover[:-1]) | ~whole[:-1])[: len(row)]
        of_core, of_cover = np.cumsum(new) - 1, np.cumsum(new_cover) - 1
        first, many = np.flatnonzero(new_cover), np.bincount(of_cover, minlength=1)
        for k in np.flatnonzero(ask & (many[of_cover] > 1)).tolist():
            i, o, h, w = row[k], first[of_cover[k]], hi[k], width - lo[k]
            j = row[o + 1] if o == k else row[o]
            if before[i][len(before[i]) - h :] == before[j][len(before[j]) - h :] and after[i][:w] == after[j][:w]:
                ask[k] = False
                most_left[i], most_right[i] = max(most_left[i], h), max(most_right[i], w)
        on = (np.bincount(of_core)[of_core] > 1) & (np.bincount(of_core, weights=ask)[of_core] > 0) & (lo < hi) if len(row) else np.empty(0, bool)
        row, lo, hi, ask = row[on], lo[on], hi[on], ask[on]
    return most_left, most_right


def merged(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The maximal runs of overlapping or touching ranges."""
    order = np.argsort(starts)
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    first = np.flatnonzero(np.append(True, starts[1:] > stops[:-1]))
    return np.stack([starts[first], stops[np.append(first[1:] - 1, len(stops) - 1)]], axis=1)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_k1, _k2, _id, _raw``: a 128-bit key of id and text, alike for rows that repeat both, which get the same ranges."""
    return docs.select(
        F.xxhash64(id_col, text_col).alias("_k1"), F.xxhash64(F.lit("2"), text_col, id_col).alias("_k2"), F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_raw")
    )


def _narrowed(docs: DataFrame, found: DataFrame, keys: list[str] | None = None, most: int = 1_000_000) -> DataFrame:
    """``docs`` joined with ``found`` by ``keys``; for at most ``most`` of 16 bytes each, other documents are dropped before the shuffle."""
    keys = keys or ["_key"]
    if found.count() <= most:
        docs = docs.join(F.broadcast(found.select(*keys)), keys, "left_semi")
    return docs.join(found, keys)


def _unique_names(raw, length: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(anchors(Names(raw), length, threshold)[1], return_counts=True)


def frequent_names(texts: DataFrame, total: int, length: int, threshold: int) -> dict[int, int]:
    """Names of anchors that occur at least once in ``FREQUENT`` documents, with a lower bound of how often they do.

    A task counts the names of 2,048 documents at a time and sends those over that share, so any name of twice the share is
    found, and there are at most ``FREQUENT`` times as many as anchors in a mean document: about 30,000 at 3 kB a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                names = [anchors(Names(part.column(0)[i].as_buffer()), length, threshold)[1] for i in range(part.num_rows)]
                found, n = np.unique(np.concatenate(names), return_counts=True)
                often = n >= max(2, -(-part.num_rows // FREQUENT))
                yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often])], names=["name", "n"])

    found = texts.select("_raw").mapInArrow(run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, total // FREQUENT))
    return {r[0]: r[1] for r in found.collect()}


def doubling_rounds(rows: DataFrame, width: int, length: int) -> DataFrame:
    """As ``solve``, for groups of any size: ``_k1, _k2, start, stop`` of what is repeated around the anchors that ask.

    ``rows`` has ``name, before, after`` and, for those that ask, ``_k1, _k2, place``. Each round halves the ranges twice,
    counts cores and covers with partial sums, and joins the counts back where hot ones need no shuffle.
    """

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                which, los, his, cores, covers, befores, afters = [], [], [], [], [], [], []
                columns = (part.column(i).to_pylist() for i in range(3, 8))
                for i, (name, lo, hi, before, after) in enumerate(zip(*columns, strict=True)):
                    step = -(-(hi - lo + 1) // 4)
                    for a in range(lo, hi + 1, step):
                        b = min(a + step - 1, hi)
                        if max(a, width - len(after)) > min(b, len(before)):
                            continue
                        tag = struct.pack(MEMBER, name, a, 0)
                        whole = b <= len(before) and width - a <= len(after)
                        x, y = before[max(0, len(before) - b) :], after[: width - a]
                        which.append(i)
                        los.append(a)
                        his.append(b)
                        cores.append(xxh3_64_intdigest(tag + before[len(before) - a :] + after[: width - b]))
                        covers.append(hashlib.blake2b(tag + x + y, digest_size=16).digest() if whole else b"")
                        befores.append(x)
                        afters.append(y)
                take = part.take(pa.array(which, pa.int64()))
                arrays = [take.column(i) for i in range(4)] + [pa.array(los, pa.int32()), pa.array(his, pa.int32()), pa.array(befores, pa.binary()), pa.array(afters, pa.binary())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.asarray(cores, np.uint64).view(np.int64)), pa.array(covers, pa.binary())], names=[*part.schema.names, "core", "cover"])

    kinds = "_k1 long, _k2 long, place long, name long, lo int, hi int, before binary, after binary"
    rows = rows.select("_k1", "_k2", "place", "name", F.lit(0).alias("lo"), F.lit(width).alias("hi"), "before", "after")
    asks, whole = F.col("place").isNotNull(), F.octet_length("cover") > 0
    found = None
    for _ in range(width.bit_length() + 1):
        halved = durable(rows.mapInArrow(halve, f"{kinds}, core long, cover binary"))
        counted = durable(halved.groupBy("core", "cover").agg(F.count("*").alias("n"), F.count_if(asks).alias("_asks")))
        left_open = F.when(whole & (F.col("n") > 1), 0).otherwise(F.col("_asks"))
        cores = durable(counted.groupBy("core").agg(F.sum("n").alias("_in_core"), F.sum(left_open).alias("_open"), F.count("*").alias("_covers")))
        total, kinds_of = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        told = join_spread(counted, cores, ["core"], "_covers", kinds_of)
        settled, goes_on = whole & (F.col("n") > 1), (F.col("_in_core") > 1) & (F.col("_open") > 0)
        told = durable(told.select("core", "cover", "n", settled.alias("_settled"), goes_on.alias("_goes_on")).where("_settled or _goes_on"))
        met = durable(join_spread(halved, told, ["core", "cover"], "n", total).drop("core", "cover", "n"))
        done = met.where(asks & F.col("_settled")).select("_k1", "_k2", (F.col("place") - F.col("hi")).alias("start"), (F.col("place") + length + width - F.col("lo")).alias("stop"))
        found = done if found is None else found.unionByName(done)
        place = F.when(F.col("_settled"), None).otherwise(F.col("place")).alias("place")
        rows = met.where(F.col("_goes_on") & (F.col("lo") < F.col("hi"))).select("_k1", "_k2", place, "name", "lo", "hi", "before", "after")
        if not rows.take(1):
            break
    return found


def _ranges(texts: DataFrame, threshold: int, crowded: int | None) -> DataFrame:
    """``_k1, _k2, start, stop``: bytes to remove; ranges of one document may overlap."""
    length = max(1, threshold * 36 // 100)
    width = threshold - length
    total = texts.count()
    most = crowded if crowded is not None else max(NOT_CROWDED, min(total // 16, CROWDED))
    often = frequent_names(texts, total, length, threshold)
    known = np.sort(np.asarray(list(often), np.int64).view(np.uint64))
    known_crowds = np.sort(np.asarray([name for name, n in often.items() if n > most], np.int64).view(np.uint64))
    shared = texts.sparkSession.sparkContext.broadcast((known, known_crowds))

    def name_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rare names of each document; one that holds a frequent name asks for itself by its key, counted as twice."""
        known = shared.value[0]
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                keys = part.column(0).to_numpy()
                which, name, times = [], [], []
                for i in range(part.num_rows):
                    found, n = _unique_names(part.column(1)[i].as_buffer(), length, threshold)
                    rare = ~np.isin(found, known, assume_unique=True)
                    if not rare.all():
                        found, n = np.append(found[rare], keys[i : i + 1].view(np.uint64)), np.append(n[rare], 2)
                    which.append(np.full(len(found), i))
                    name.append(found)
                    times.append(n)
                if which:
                    columns = [pa.array(np.concatenate(name).view(np.int64)), pa.array(np.concatenate(times).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate(which))), *columns], names=["_k1", "name", "times"])

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Surroundings of the anchors that are left, equal ones of a task merged, with the places where they are."""
        from xxhash import xxh3_64_intdigest

        known, known_crowds = shared.value
        held: dict[tuple[int, bool, bytes, bytes], bytearray] = {}
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(entries := list(held.items())), 10_000):
                some = entries[at : at + 10_000]
                names, crowd, before, after = zip(*(k for k, _ in some), strict=True)
                salt = [np.int64(np.uint64(xxh3_64_intdigest(b + a))) if c else 0 for c, b, a in zip(crowd, before, after, strict=True)]
                members = [bytes(m) for _, m in some]
                arrays = [pa.array(names, pa.int64()), pa.array(salt, pa.int64()), pa.array(crowd), pa.array(before, pa.binary()), pa.array(after, pa.binary()), pa.array(members, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["name", "salt", "crowd", "before", "after", "members"])
            held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                k1, k2, raw = (batch.column(c)[i].as_py() for c in range(3))
                rare, crowd = (np.asarray(batch.column(c)[i].values, np.int64).view(np.uint64) for c in (3, 4))
                place, name = anchors(Names(raw), length, threshold)
                in_crowd = np.isin(name, known_crowds) | np.isin(name, crowd)
                alive = in_crowd | np.isin(name, rare) | np.isin(name, known)
                for p, x, c in zip(place[alive].tolist(), name[alive].view(np.int64).tolist(), in_crowd[alive].tolist(), strict=True):
                    key = (x, c, raw[max(0, p - width) : p], raw[p + length : p + length + width])
                    held.setdefault(key, bytearray()).extend(struct.pack(MEMBER, k1, k2, p))
                    size += MEMBER_SIZE
                if len(held) > MERGED or size > 64 << 20:
                    yield from sent()
                    size = 0
        yield from sent()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < SOLVED:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            name, salt = rows["name"].to_numpy(), rows["salt"].to_numpy()
            cut = int(np.argmax((name == name[-1]) & (salt == salt[-1])))  # the last group may go on
            if cut:
                yield settled(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
        if held:
            yield settled(pa.Table.from_batches(held))

    def settled(rows: pa.Table) -> pa.RecordBatch:
        merged_rows: dict[tuple[int, bool, bytes, bytes], bytes] = {}
        for *key, members in zip(*(rows[c].to_pylist() for c in ("name", "crowd", "before", "after", "members")), strict=True):
            key = tuple(key)
            merged_rows[key] = merged_rows[key] + members if key in merged_rows else members
        names, crowd, before, after = (list(x) for x in zip(*merged_rows, strict=True))
        members = list(merged_rows.values())
        times = np.fromiter(map(len, members), np.int64, len(members)) // MEMBER_SIZE
        names, crowd = np.asarray(names, np.int64), np.asarray(crowd)
        fits = np.fromiter((len(b) + len(a) for b, a in zip(before, after, strict=True)), np.int64, len(times)) >= width
        left, right = np.full(len(times), -1), np.full(len(times), -1)
        repeated = fits & (times > 1)
        left[repeated] = [len(before[i]) for i in np.flatnonzero(repeated)]
        right[repeated] = [len(after[i]) for i in np.flatnonzero(repeated)]
        some = np.flatnonzero(fits & ~crowd)
        if len(some):
            found = solve(names[some].view(np.uint64), [before[i] for i in some], [after[i] for i in some], times[some] == 1, width)
            left[some], right[some] = np.maximum(left[some], found[0]), np.maximum(right[some], found[1])
        hit = np.flatnonzero(left >= 0)
        at = np.frombuffer(b"".join([members[i] for i in hit]), MEMBERS)
        start = at["place"] - np.repeat(left[hit], times[hit])
        stop = at["place"] + length + np.repeat(right[hit], times[hit])
        # those of crowded names go on: with their place if they ask, without if they are told
        on = np.flatnonzero(crowd & fits)
        lone = np.frombuffer(b"".join([members[i][: MEMBER_SIZE] for i in on]), MEMBERS)
        mask = np.concatenate([np.zeros(len(at), bool), times[on] > 1])
        none = pa.nulls(len(at), pa.int64())
        both = lambda a, b: pa.array(np.concatenate([a, b]).astype(np.int64), mask=mask)
        arrays = [
            both(at["k1"], lone["k1"]), both(at["k2"], lone["k2"]), both(start, lone["place"]), pa.concat_arrays([pa.array(stop.astype(np.int64)), pa.nulls(len(on), pa.int64())]),
            pa.concat_arrays([none, pa.array(names[on])]), *(pa.concat_arrays([pa.nulls(len(at), pa.binary()), pa.array([x[i] for i in on], pa.binary())]) for x in (before, after)),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["_k1", "_k2", "start", "stop", "name", "before", "after"])

    counted = texts.select("_k1", "_raw").mapInArrow(name_anchors, "_k1 long, name long, times int").withColumn("_all", F.sum("times").over(W.partitionBy("name")))
    many = F.col("_all") > most
    alive = counted.where("_all > 1").groupBy("_k1").agg(F.collect_list(F.when(~many, F.col("name"))).alias("rare"), F.collect_list(F.when(many, F.col("name"))).alias("crowd"))
    around = _narrowed(texts, durable(alive), ["_k1"]).select("_k1", "_k2", "_raw", "rare", "crowd").mapInArrow(surround, "name long, salt long, crowd boolean, before binary, after binary, members binary")
    dealt = around.repartition("name", "salt").sortWithinPartitions("name", "salt")
    told = durable(dealt.mapInArrow(settle, "_k1 long, _k2 long, start long, stop long, name long, before binary, after binary"))
    ranges = told.where("name is null").select("_k1", "_k2", "start", "stop")
    crowds = told.where("name is not null").select("_k1", "_k2", F.col("start").alias("place"), "name", "before", "after")
    if crowds.take(1):
        ranges = ranges.unionByName(doubling_rounds(crowds, width, length))
    return ranges


def _cut(docs: DataFrame, id_col: str, text_col: str, threshold: int, crowded: int | None) -> DataFrame:
    """``_k1, _k2, _id, text_sha256, spans, kept``, a row for each row of ``docs`` that has something to remove."""
    base = _keyed(docs, id_col, text_col)
    ranges = _ranges(base.where(F.octet_length("_raw") >= threshold).select("_k1", "_k2", "_raw"), threshold, crowded)
    cuts = durable(ranges.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("start", "stop")).alias("ranges")))
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                digests, spans, kept = [], [], []
                for i in range(part.num_rows):
                    raw, ranges = part.column(3)[i].as_py(), part.column(4)[i].values
                    found = merged(np.asarray(ranges.field("start")), np.asarray(ranges.field("stop")))
                    digests.append(hashlib.sha256(raw).hexdigest())
                    spans.append([{"start": a, "stop": b} for a, b in found.tolist()])
                    stops, starts = [0, *found[:, 1].tolist()], [*found[:, 0].tolist(), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(stops, starts, strict=True)))
                span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(3)), pa.array(digests), pa.array(spans, span), pa.array(kept, pa.binary())], names=["_k1", "_k2", "_id", "text_sha256", "spans", "kept"])

    touched = _narrowed(base, cuts, ["_k1", "_k2"]).select("_k1", "_k2", "_id", "_raw", "ranges")
    return touched.mapInArrow(cut, f"_k1 long, _k2 long, _id {id_type}, text_sha256 string, spans array<struct<start:long,stop:long>>, kept binary")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 200, crowded: int | None = None) -> DataFrame:
    """One row per document that holds a string of ``threshold`` bytes which also starts elsewhere.

    Columns: ``id_col``, ``text_sha256`` (of the whole text), ``spans`` (array of start and stop, in bytes, of the maximal
    runs to remove) and ``kept`` (the other bytes, joined; they may cut a character in two). Texts are UTF-8; matches don't
    cross documents, may overlap, and are judged on the input. Null texts are empty; texts shorter than the threshold are
    never removed from; documents of repeated ids count each, and a repeated row has its result once; other columns are
    ignored; an empty table gives no rows. Every byte of every text takes part.

    Names that many documents hold are told beforehand and are not shuffled; surroundings of anchors are merged within
    each task before they meet, so copies don't pile up. Anchors whose name occurs over ``crowded`` times (by default once
    in sixteen documents, at least 1,000 and at most 20,000) are dealt out by their surroundings; the result is the same.
    """
    cut = _cut(docs, id_col, text_col, threshold, crowded).dropDuplicates(["_k1", "_k2"])
    return cut.select(F.col("_id").alias(id_col), "text_sha256", "spans", "kept")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 200, crowded: int | None = None) -> DataFrame:
    """One row per document: ``id_col, n_bytes, n_removed, n_spans, kept_sha256``, by the same cuts as ``repeats``."""
    cut = _cut(docs, id_col, text_col, threshold, crowded)
    cut = cut.select("_k1", "_k2", F.octet_length("kept").alias("_left"), F.size("spans").alias("_spans"), F.sha2("kept", 256).alias("_kept_sha")).dropDuplicates(["_k1", "_k2"])
    raw = F.coalesce("_raw", F.lit(b""))
    all_docs = _keyed(docs, id_col, text_col).select("_id", "_k1", "_k2", F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("_sha"))
    return all_docs.join(cut, ["_k1", "_k2"], "left").select(
        F.col("_id").alias(id_col),
        "n_bytes",
        (F.col("n_bytes") - F.coalesce(F.col("_left").cast("long"), F.col("n_bytes"))).alias("n_removed"),
        F.coalesce(F.col("_spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("_kept_sha", "_sha").alias("kept_sha256"),
    )
