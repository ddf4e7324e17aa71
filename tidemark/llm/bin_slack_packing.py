"""Packing whole documents into as few sequences as can be, by minimum bin slack.

Sequences depend on lengths alone, of which there are as many as a sequence has places. The driver gets how often each
length occurs and fills sequence after sequence: the longest piece left opens it, and a subset-sum programme over the
lengths left, whose states are the bits of one integer, finds the combination that fills it best. A combination is taken
as often as there are pieces for it, so the plan is as long as there are combinations, not sequences. Every piece then
finds its place by its rank among the pieces of its length, which tasks give out without seeing each other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable
from tidemark.llm.curve_packing import WordTokenizer, id_type

#: Tasks whose tallies are added up first, so that no running sum goes over all tasks.
GROUP = 1024


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths and multiplicities, within ``counts``, of a combination that fills ``room`` as far as any does.

    Bit ``s`` of ``reach`` says that some combination of the lengths seen so far adds up to ``s``. Copies of a length are
    entered in powers of two; what was reached before each entry is kept, and the way back through it names the pieces.
    Longer lengths are entered first and the way ends as soon as the room is filled, so short ones are left for later.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= (reach << (length * copies)) & mask
            left -= copies
            copies *= 2
        if reach >> room:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> at & 1:  # not reached without this entry
            taken[length] = taken.get(length, 0) + copies
            at -= length * copies
    return taken


def plan(counts: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """Combinations of lengths with how many sequences in a row take each: minimum bin slack over ``counts``.

    The longest length left opens a sequence, so what is left always gets shorter. A combination stays the answer as long
    as its pieces last, since the lengths to choose from only become fewer. There are at most ``size`` lengths, and each
    entry leaves one of its lengths with fewer pieces than it takes.
    """
    left = {k: n for k, n in counts.items() if n}
    out = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        combination = fullest({k: n for k, n in rest.items() if n}, size - longest)
        combination[longest] = combination.get(longest, 0) + 1
        times = min(left[k] // m for k, m in combination.items())
        out.append((times, combination))
        for k, m in combination.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
    return out


def placement(combinations: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows ``length, first rank, copies, first sequence, first offset``, by length and rank: where the pieces of a length go."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for times, combination in combinations:
        offset = 0
        for length in sorted(combination, reverse=True):
            copies = combination[length]
            rows.append((length, taken.get(length, 0), copies, sequence, offset))
            taken[length] = taken.get(length, 0) + copies * times
            offset += copies * length
        sequence += times
    return np.asarray(sorted(rows), dtype=np.int64).reshape(-1, 5)


def places(table: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by length and rank."""
    key = lambda length, rank: (length << 48) | rank  # noqa: E731  fewer than 2**48 pieces of a length
    row = table[np.searchsorted(key(table[:, 0], table[:, 1]), key(lengths, ranks), side="right") - 1]
    nth = ranks - row[:, 1]
    return row[:, 3] + nth // row[:, 2], row[:, 4] + (nth % row[:, 2]) * lengths


def cut(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, size: int, end_id: int) -> DataFrame:
    """``_id, piece, start, length, ids_crc32, ids, _task, _nth`` of every piece; ``_nth`` counts the pieces of its length in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, task = WordTokenizer(tokenizer_path), TaskContext.get().partitionId()
        kind = id_type(tokenizer.tokenizer.get_vocab_size(), end_id)
        seen = [0] * (size + 1)
        names = ["_id", "piece", "start", "length", "ids_crc32", "ids", "_task", "_nth"]
        kinds = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                of, rows = [], []
                for i, text in enumerate(part.column(1)):
                    ids = np.append(tokenizer.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), size)):
                        own = ids[start : start + size]
                        of.append(i)
                        rows.append((piece, start, len(own), zlib.crc32(own.tobytes()), own.astype(kind).tobytes(), task, seen[len(own)]))
                        seen[len(own)] += 1
                columns = [part.column(0).take(pa.array(of)), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return read.mapInArrow(run, f"_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary, _task int, _nth long")


def ranks(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How often each task has each length, with the number of such pieces in earlier tasks (``_before``); and the totals by length."""
    tallies = durable(pieces.groupBy("_task", "length").agg(F.count("*").alias("_n")))
    grouped = tallies.withColumn("_group", F.floor(F.col("_task") / GROUP))
    sums = grouped.groupBy("length", "_group").agg(F.sum("_n").alias("_n"))
    earlier = lambda *keys, by: F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("length", "_group", earlier("length", by="_group").alias("_groups"))
    inside = grouped.withColumn("_inside", earlier("length", "_group", by="_task"))
    before = inside.join(sums, ["length", "_group"]).select("_task", "length", (F.col("_inside") + F.col("_groups")).alias("_before"))
    return before, tallies.groupBy("length").agg(F.sum("_n").alias("n"))


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0, with_ids: bool = True
) -> DataFrame:
    """Packs all documents into sequences of at most ``size`` ids: one row per piece of a document.

    Columns: ``id_col, piece, start, length, ids_crc32, sequence_id, offset`` and, ``with_ids``, ``ids``: little-endian, two
    bytes each where the vocabulary allows it and else four (``ids_crc32`` is that of four bytes each). A document is its
    ids and ``end_id``; only those longer than ``size`` are cut, every ``size`` ids. Null and empty texts are one piece of
    ``end_id`` alone. Repeated ids are documents of their own; an empty table gives no rows; further columns are ignored;
    pieces of one length are placed in the order of the tasks that read them.

    The driver holds one count for each length and one row for each length of each combination. Pieces are written once;
    they are shuffled by (task, length), so no key has more rows than a task had.
    """
    pieces = durable(cut(docs, tokenizer_path, id_col, text_col, size, end_id))
    before, totals = ranks(pieces)
    counts = {r["length"]: r["n"] for r in totals.collect()}  # at most ``size`` rows
    shared = docs.sparkSession.sparkContext.broadcast(placement(plan(counts, size)))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places(shared.value, batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    ranked = pieces.join(before, ["_task", "length"]).select(*names, (F.col("_nth") + F.col("_before")).alias("_rank"))
    out = f"_id {kind}, piece int, start long, length long, ids_crc32 long, {'ids binary, ' * with_ids}sequence_id long, offset long"
    return ranked.mapInArrow(place, out).withColumnRenamed("_id", id_col)
