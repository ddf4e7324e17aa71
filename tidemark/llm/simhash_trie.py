"""SimHash near-duplicates by self-joins of binary tries.

Every distinct fingerprint is a path in a binary trie. Two fingerprints at most k bits apart agree on one of k + 1 parts
of their bits, so the trie is dealt out by parts: for each part, fingerprints with the same value of it form one subtree,
once the bits are turned so that this part comes first. A subtree that holds too many fingerprints is dealt out again by
parts of its remaining bits. Each subtree is joined with itself: pairs of nodes go down together one bit at a time,
the differing bits add up, and a pair is dropped as soon as they exceed the error budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, components, durable, join_spread, numbered

BITS = 64
#: Node pairs that one step of the trie join takes down together.
FRONTIER = 1 << 16
#: Products of node sizes from which a pair of nodes is no longer split but compared outright.
OUTRIGHT = 64
#: Pairs found, above as many as there are fingerprints, at which they are thinned to a spanning forest.
HELD = 1 << 18


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of a whole text: bit b is set if it is set in over half of the XXH64 values of its word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - width + 1)
    starts = np.append(0, ends[: n - 1]).tolist()
    stops = (ends[width - 1 :] - 1).tolist() if len(words) >= width else [len(joined)]
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), dtype="<u8", count=n)
    set_in = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * set_in > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``_id, _fp`` (the 64 bits as a signed long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["_id", "_fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, _fp long")


def parts_of(first: int, bits: int, parts: int) -> list[tuple[int, int]]:
    """``bits`` places from ``first`` on, cut into runs: first place and length of each, places counted from the highest bit."""
    cuts = [first + bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def turned(fp: Column, first: int, length: int, below: int = 0) -> Column:
    """The bits from place ``below`` on with the run moved to their front; the ``below`` highest bits stay."""
    span = BITS - below
    keep = (1 << span) - 1
    low = fp.bitwiseAND(F.lit(_signed(keep)))
    shift = first - below
    front = F.shiftleft(low, shift).bitwiseAND(F.lit(_signed(keep))) if shift else low
    back = F.shiftrightunsigned(low, span - shift) if shift else F.lit(0).cast("long")
    return fp.bitwiseAND(F.lit(_signed(((1 << BITS) - 1) ^ keep))).bitwiseOR(front.bitwiseOR(back))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def trie_self_join(fps: np.ndarray, roots: np.ndarray, depth: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indices of fingerprints under the same root at most ``budget`` bits apart.

    ``fps`` are uint64, ascending within each root; ``roots`` are the first index of each root and the end; ``depth`` is
    how many leading bits each root's fingerprints share. A node is a range of the array. Pairs are thinned to a spanning
    forest whenever many are held, so fewer are returned than there are fingerprints, and memory is bounded in dense balls.
    """
    out_a, out_b, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0

    def thinned() -> tuple[np.ndarray, np.ndarray]:
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        keep = spanning(a, b)
        return a[keep], b[keep]

    lo, hi = roots[:-1].astype(np.int64), roots[1:].astype(np.int64)
    big = hi - lo > 1
    stack = [(lo[big], hi[big], lo[big], hi[big], depth[big].astype(np.int64), np.zeros(int(big.sum()), np.int64))]
    while stack:
        a0, a1, b0, b1, d, err = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [tuple(x[:half] for x in (a0, a1, b0, b1, d, err)), tuple(x[half:] for x in (a0, a1, b0, b1, d, err))]
            continue
        small = ((a1 - a0) * (b1 - b0) <= OUTRIGHT) | (d >= BITS)
        if small.any():
            sa0, sb0 = a0[small], b0[small]
            na, nb = (a1 - a0)[small], (b1 - b0)[small]
            size = na * nb
            which = np.repeat(np.arange(len(size)), size)
            k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            i, j = sa0[which] + k // nb[which], sb0[which] + k % nb[which]
            near = (i < j) & (np.bitwise_count(fps[i] ^ fps[j]) <= budget)
            out_a.append(i[near])
            out_b.append(j[near])
            found += int(near.sum())
            if found > HELD + 2 * len(fps):
                a, b = thinned()
                out_a, out_b, found = [a], [b], len(a)
        big = ~small
        if not big.any():
            continue
        a0, a1, b0, b1, d, err = (x[big] for x in (a0, a1, b0, b1, d, err))
        am, bm = _split(fps, a0, a1, d), _split(fps, b0, b1, d)
        same = (a0 == b0) & (a1 == b1)
        children = []
        for ca, cb in ((0, 0), (1, 1), (0, 1), (1, 0)):
            x0, x1 = (a0, am) if ca == 0 else (am, a1)
            y0, y1 = (b0, bm) if cb == 0 else (bm, b1)
            e = err + (ca != cb)
            ok = (x1 > x0) & (y1 > y0) & (e <= budget)
            if (ca, cb) == (1, 0):
                ok &= ~same  # a node with itself: the mirror image of (0, 1)
            if ca == cb:
                ok &= ~(same & (x1 - x0 == 1))  # a single fingerprint with itself
            children.append(tuple(x[ok] for x in (x0, x1, y0, y1, d + 1, e)))
        stack.append(tuple(np.concatenate(x) for x in zip(*children, strict=True)))
    return thinned()


def _split(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """In each range, the first index whose bit at ``depth`` is set: a binary search in all ranges at once."""
    lo, hi = lo.copy(), hi.copy()
    shift = (BITS - 1 - depth).astype(np.uint64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        one = ((fps[np.minimum(mid, len(fps) - 1)] >> shift) & np.uint64(1)) == 1
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs join two parts that the pairs before them leave apart (union-find)."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(names)))
    keep = np.zeros(len(a), dtype=bool)
    for k, (x, y) in enumerate(zip(flat[: len(a)].tolist(), flat[len(a) :].tolist(), strict=True)):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x != y:
            up[max(x, y)] = min(x, y)
            keep[k] = True
    return keep


def links(reps: DataFrame, budget: int = 3, hot: int = 20_000) -> DataFrame:
    """Edges ``a, b`` between ids whose distinct fingerprints are at most ``budget`` bits apart.

    ``reps`` has ``_rep`` (long) and a distinct ``_fp`` each. Within a subtree a spanning forest of the links found
    there is returned, so that a dense group gives no more edges than members; connectivity is that of all links. A
    subtree is held by one task: of those dealt out again the members share 28 bits, 37 in the mean at 10**10 fingerprints.
    """
    level1 = parts_of(0, BITS, budget + 1)
    spread = reps.select(
        "_rep",
        F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.lit(n).alias("shared"), turned(F.col("_fp"), p, n).alias("fp")) for i, (p, n) in enumerate(level1)])).alias("x"),
    ).select("_rep", F.col("x.part").cast("long").alias("part"), "x.shared", "x.fp")
    width = BITS // (budget + 1)
    spread = spread.withColumn("key", F.shiftrightunsigned("fp", BITS - width))
    crowded = spread.groupBy("part", "key").count().where(F.col("count") > hot).select("part", "key", F.lit(True).alias("crowded"))
    marked = spread.join(F.broadcast(crowded), ["part", "key"], "left")  # at most (budget + 1) * 2**16 keys
    level2 = parts_of(width, BITS - width, budget + 1)
    again = F.array(*[F.struct((F.col("part") * 16 + i + 1).alias("part"), F.lit(width + n).alias("shared"), turned(F.col("fp"), p, n, width).alias("fp")) for i, (p, n) in enumerate(level2)])
    whole = F.array(F.struct((F.col("part") * 16).alias("part"), F.lit(width).alias("shared"), F.col("fp")))
    dealt = marked.select("_rep", F.explode(F.when(F.col("crowded"), again).otherwise(whole)).alias("x")).select("_rep", "x.part", "x.shared", "x.fp")
    # the leading bits that a subtree shares, as its key
    dealt = dealt.withColumn("key", F.expr("shiftrightunsigned(fp, 64 - shared)"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = (frame["part"] == frame["part"].iloc[-1]) & (frame["key"] == frame["key"].iloc[-1])
            cut = int(np.argmax(last.to_numpy()))
            rest = frame.iloc[cut:]
            if cut:
                yield joined(frame.iloc[:cut])
        if rest is not None and len(rest):
            yield joined(rest)

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        part, key = frame["part"].to_numpy(), frame["key"].to_numpy()
        fps, rep = frame["fp"].to_numpy().view(np.uint64), frame["_rep"].to_numpy()
        order = np.lexsort((fps, key, part))
        part, key, fps, rep, shared = part[order], key[order], fps[order], rep[order], frame["shared"].to_numpy()[order]
        first = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])))
        i, j = trie_self_join(fps, np.append(first, len(fps)), shared[first], budget)
        return pd.DataFrame({"a": rep[i], "b": rep[j]})

    return dealt.repartition("part", "key").sortWithinPartitions("part", "key").mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 3, width: int = 3) -> DataFrame:
    """One row per document: ``id_col`` (a number), ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable).

    Texts are lowered (A-Z) and cut at ASCII white space into words; fingerprints at most ``budget`` bits apart are
    linked, and links are followed to the end. Null, empty and blank texts have fingerprint zero and link as any other.
    Rows that repeat an id are returned each; a row without an id is returned with a null component unless others share
    its fingerprint. Other columns are ignored; an empty table gives no rows. Equal fingerprints, however many, are one
    node of the graph.
    """
    marked = durable(fingerprints(docs, id_col, text_col, width))
    reps = durable(marked.groupBy("_fp").agg(F.min("_id").cast("long").alias("_rep"), F.count("*").alias("_n")))
    found = components(links(reps.where("_rep is not null"), budget))
    named = durable(reps.join(found, reps["_rep"] == found["node"], "left").select("_fp", "_n", F.coalesce("component", "_rep").alias("component_id")))
    total = named.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hexed = F.lower(F.lpad(F.hex("_fp"), 16, "0"))
    return join_spread(marked, named, ["_fp"], "_n", total).select(F.col("_id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def keep_one_of_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 3, width: int = 3) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, the one of smallest id; all columns stay.

    Rows without an id come after those with one; of rows that are alike in id any one stays.
    """
    rows = numbered(docs)
    near = near_duplicates(rows, ROW, text_col, budget, width).select(ROW, "component_id")
    order = F.struct(F.col(id_col).isNull().alias("_none"), F.col(id_col).alias("_id"), ROW)
    best = rows.select(ROW, order.alias("_order")).join(near, ROW).groupBy("component_id").agg(F.min("_order").alias("_best"))
    return rows.join(best.select(F.col(f"_best.{ROW}").alias(ROW)), ROW, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
