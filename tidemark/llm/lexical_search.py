"""Ranked lexical search as a blocked product of sparse matrices.

Items (the queries) are dealt into blocks of bounded bytes; a block is an item-term matrix of multiplicities. All documents
are read once for a block and leave the term-document matrix of the block's terms, in blocks of documents that hold the
matrix term by term. Once document frequencies are known, its entries become int64 impacts and both are multiplied row by
row: the rows of an item's terms are merged into one row of scores, of which each task keeps the best.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, durable, numbered

#: Bytes of a term are letters and digits of ASCII, A-Z lowered, and all beyond ASCII; any other byte ends a term.
FOLD = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256)).lower()
#: Groups that a document side's best rows are reduced in before those of an item meet.
SALTS = 256


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return (text or b"").translate(FOLD).split()


def weight(n_docs: int, doc_frequency: int) -> int:
    """What a term weighs that ``doc_frequency`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * doc_frequency + 1)))


def length_factor(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The divisor's share of documents of ``n`` terms; Python's integers where 64 bits would not do."""
    if 25 * int(n.max(initial=0)) * n_docs >= 1 << 63:
        return np.asarray([75 + (25 * x * n_docs) // n_terms for x in n.tolist()], dtype=np.int64)
    return 75 + (25 * n.astype(np.int64) * n_docs) // max(n_terms, 1)


def leading(values: np.ndarray, k: int, least: int) -> np.ndarray:
    """Positions of the ``k`` greatest of those ``values`` that are at least ``least``, greatest first, equal ones in order."""
    found = np.flatnonzero(values >= least)
    if len(found) > k:
        v = values[found]
        kth = np.partition(v, len(v) - k)[len(v) - k]
        above = found[v > kth]
        found = np.sort(np.concatenate([above, found[v == kth][: k - len(above)]]))
    return found[np.argsort(-values[found], kind="stable")]


def item_matrices(items: DataFrame, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """One row per block of items: its distinct terms, and a compressed sparse matrix of their multiplicities."""
    size = items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1

    def build(part: pd.DataFrame) -> pd.DataFrame:
        number: dict[bytes, int] = {}
        ends, cols, times, rows = [0], [], [], []
        for row, text in zip(part["row"], part["text"], strict=True):
            ids, n = np.unique(np.asarray([number.setdefault(t, len(number) + 1) for t in terms(text)], dtype=np.int64), return_counts=True)
            if len(ids):
                rows.append(row)
                cols.append(ids)
                times.append(n)
                ends.append(ends[-1] + len(ids))
        packed = [np.concatenate([*x, np.empty(0, np.int64)]).astype("<i8").tobytes() for x in ([rows], [ends], cols, times)]
        return pd.DataFrame([(int(part["block"].iloc[0]), b" ".join(number), *packed)], columns=["block", "terms", "rows", "ends", "cols", "times"])

    dealt = items.select(F.pmod(F.xxhash64(ROW), F.lit(blocks)).cast("int").alias("block"), F.col(ROW).alias("row"), F.col(text_col).cast("binary").alias("text"))
    return dealt.groupBy("block").applyInPandas(build, "block int, terms binary, rows binary, ends binary, cols binary, times binary"), blocks


def term_document_blocks(docs: DataFrame, id_col: str, text_col: str, shared, block_docs: int, block_bytes: int) -> DataFrame:
    """The term-document matrix of the broadcast terms, a row per block of documents.

    ``ids, n`` (all terms of each document), ``n_docs`` (documents with a term), ``n_terms``; ``terms, dfs`` (the terms that
    occur and in how many of the block's documents), ``docs, tf``: document and count of every entry, term by term.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = {t: i for i, t in enumerate(shared.value.split(b" "), 1)}.get
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
            at = 0
            while at < batch.num_rows:
                before = int(sizes[at - 1]) if at else 0
                upto = int(np.searchsorted(sizes, before + block_bytes, side="right"))
                part = batch.slice(at, min(max(upto - at, 1), block_docs))
                at += part.num_rows
                # in the order of ids, so that a document's place decides between equal scores
                part = part.take(pc.sort_indices(part.column(0), null_placement="at_start"))
                n, found = [], []
                for text in part.column(1):
                    words = terms(text.as_py())
                    n.append(len(words))
                    found.append(np.frombuffer(array("I", filter(None, map(get, words))), dtype="u4").astype(np.int64))
                place = np.repeat(np.arange(len(n)), [len(x) for x in found])
                key, tf = np.unique((np.concatenate(found) << 32) | place, return_counts=True)
                here, df = np.unique(key >> 32, return_counts=True)
                n = np.asarray(n, dtype=np.int64)
                row = {
                    "ids": pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0)),
                    "n": pa.array([n.astype("<u4").tobytes()], pa.binary()),
                    "n_docs": pa.array([int((n > 0).sum())], pa.int64()),
                    "n_terms": pa.array([int(n.sum())], pa.int64()),
                    "terms": pa.array([here.tolist()], pa.list_(pa.int32())),
                    "dfs": pa.array([df.tolist()], pa.list_(pa.int32())),
                    "docs": pa.array([(key & 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary()),
                    "tf": pa.array([tf.astype("<u4").tobytes()], pa.binary()),
                }
                yield pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

    schema = f"ids array<{kind}>, n binary, n_docs long, n_terms long, terms array<int>, dfs array<int>, docs binary, tf binary"
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("binary")).mapInArrow(run, schema)


def best_of_product(blocks: DataFrame, id_type: str, shared, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``_row, _id, score, _salt``: of each item and task at most ``k`` documents a block, those that may be among its best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows, ends, cols, times, weights = shared.value
        salt = TaskContext.get().partitionId() % SALTS
        best = np.zeros((len(rows), k), dtype=np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                ids, n, here, df, docs, tf = (batch.column(c)[r] for c in ("ids", "n", "terms", "dfs", "docs", "tf"))
                ids, here, df = ids.values, here.values.to_numpy(), df.values.to_numpy()
                docs, tf = np.frombuffer(docs.as_py(), "<u4").astype(np.int64), np.frombuffer(tf.as_py(), "<u4").astype(np.int64)
                m = length_factor(np.frombuffer(n.as_py(), "<u4"), n_docs, n_terms)
                impact = np.repeat(weights[here], df) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[docs]))
                starts = np.append(0, np.cumsum(df))
                place = np.full(len(weights), -1, dtype=np.int64)
                place[here] = np.arange(len(here))
                out_rows, out_docs, out_scores = [], [], []
                for i in range(len(rows)):
                    mine = slice(ends[i], ends[i + 1])
                    at = place[cols[mine]]
                    merged = np.zeros(len(ids), dtype=np.int64)
                    for j, a in zip(at[at >= 0].tolist(), times[mine][at >= 0].tolist(), strict=True):
                        s, e = starts[j], starts[j + 1]
                        merged[docs[s:e]] += a * impact[s:e]
                    first = leading(merged, k, max(1, int(best[i, 0])))
                    if len(first):
                        scores = merged[first]
                        best[i] = np.sort(np.concatenate([best[i], scores]))[-k:]
                        out_rows.append(np.full(len(first), rows[i]))
                        out_docs.append(first)
                        out_scores.append(scores)
                if out_rows:
                    scores = np.concatenate(out_scores)
                    columns = [pa.array(np.concatenate(out_rows), pa.int64()), ids.take(pa.array(np.concatenate(out_docs))), pa.array(scores, pa.int64()), pa.array(np.full(len(scores), salt), pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["_row", "_id", "score", "_salt"])

    return blocks.mapInArrow(run, f"_row long, _id {id_type}, score long, _salt int")


def search(
    items: DataFrame,
    docs: DataFrame,
    item_id: str = "item_id",
    item_text: str = "text",
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 20,
    item_block_bytes: int = 4 << 20,
    block_docs: int = 8192,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id, rank, doc_id, score`` (named so, whatever the inputs call them).

    Terms are runs of ASCII letters and digits, A-Z lowered, and of characters beyond ASCII. A document scores the sum of
    its terms' int64 impacts times their multiplicity in the item; only scores above 0 are ranked, equal scores by
    ascending id (nulls first). Null and empty texts have no terms: such items have no rows, such documents are not
    counted. Rows are items and documents of their own, also where ids repeat; copies of one document tie and are ranked by
    id. Empty tables give no rows; further columns are ignored. Ids must be orderable.

    Documents are read once for every ``item_block_bytes`` of items, half of which is what a broadcast matrix stands for;
    the term-document matrix holds only the items' terms. A task holds one block of documents (``block_docs`` rows and
    ``block_bytes`` of text, or one longer text) and ``k`` scores an item. The best rows of an item are reduced in
    ``SALTS`` groups before they meet.
    """
    spark = docs.sparkSession
    items = numbered(items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("_text")))
    matrices, _ = item_matrices(items, "_text", item_block_bytes)
    matrices = durable(matrices)
    id_type = docs.schema[id_col].dataType.simpleString()
    best = None
    for (block,) in matrices.select("block").orderBy("block").toLocalIterator():
        held = matrices.where(F.col("block") == block).first()
        if not held["terms"]:
            continue
        rows, ends, cols, times = (np.frombuffer(bytes(held[c]), "<i8") for c in ("rows", "ends", "cols", "times"))
        vocabulary = spark.sparkContext.broadcast(bytes(held["terms"]))
        blocks = durable(term_document_blocks(docs, id_col, text_col, vocabulary, block_docs, block_bytes))
        n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        weights = np.zeros(held["terms"].count(b" ") + 2, dtype=np.int64)
        entries = blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x"))
        for term, df in entries.groupBy("x.terms").agg(F.sum("x.dfs")).collect():  # one row for each term of the block of items
            weights[term] = weight(n_docs, df)
        shared = spark.sparkContext.broadcast((rows, ends, cols, times, weights))
        part = best_of_product(blocks, id_type, shared, n_docs, n_terms, k)
        best = part if best is None else best.unionByName(part)
    if best is None:
        best = spark.createDataFrame([], f"_row long, _id {id_type}, score long, _salt int")
    order = [F.col("score").desc(), F.col("_id").asc_nulls_first()]
    for keys in (["_row", "_salt"], ["_row"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return best.join(items.select(F.col(ROW).alias("_row"), "item_id"), "_row").select("item_id", "rank", F.col("_id").alias("doc_id"), "score")
