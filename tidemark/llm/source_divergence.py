"""Audit of how the sources of a language differ in their words, by sorted streams of runs.

Each task sorts the (language, term, source, document) of its documents and scans them for runs, which leaves one row a
run with its documents and occurrences. Rows are dealt by language, term and source, sorted by (language, term, source,
document) and scanned again, then once more by language and term: what a scan holds is a run, never a group. Terms in
enough documents are kept; a last scan over their runs adds up partial sums for pairs of sources and keeps the terms
that stand out most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable
from tidemark.llm.lexical_search import leading

#: Letters of ASCII, A-Z lowered, and all bytes beyond ASCII belong to terms; any other byte ends one.
FOLD = bytes(b if b > 0x7F or chr(b).isalpha() else 0x20 for b in range(256)).lower()
SCALE = 1_000_000_000
#: Most sums for pairs of sources that a task holds; a language with more has its sums sent on batch by batch.
HELD_PAIRS = 1 << 21


def shares(counts: np.ndarray, totals: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact in 64 bits by division in three steps."""
    whole = totals + 2 * kept
    q, r = np.zeros_like(counts), counts + 2
    for _ in range(3):
        r = r * 1000
        q, r = q * 1000 + r // whole, r % whole
    return q + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def local_runs(docs: DataFrame, text_col: str, lang_col: str, source_col: str, block_bytes: int) -> DataFrame:
    """``lang, term, source, document, df, n`` of each run of a block of documents; ``document`` is the block's number.

    A row without a term stands for the block's documents of a language and source.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        document = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(0)).to_numpy())
            at = 0
            while at < batch.num_rows:
                upto = int(np.searchsorted(sizes, (int(sizes[at - 1]) if at else 0) + block_bytes, side="right"))
                part = batch.slice(at, max(upto - at, 1))
                at += part.num_rows
                number: dict[bytes, int] = {}
                groups: dict[tuple, int] = {}
                group = np.asarray([groups.setdefault(x, len(groups)) for x in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)])
                found = []
                for text in part.column(0):
                    words = text.as_py().translate(FOLD).split()
                    found.append(np.fromiter([number.setdefault(w, len(number)) for w in words], dtype=np.int64, count=len(words)))
                place = np.repeat(np.arange(len(found)), [len(x) for x in found])
                # sorted by group, term and document: runs of one document first, then those of one term
                ids = group[place] * max(len(number), 1) + np.concatenate(found)
                key, tf = np.unique(ids * part.num_rows + place, return_counts=True)
                ids = key // part.num_rows
                first = _starts([ids])
                df, n = np.diff(np.append(first, len(key))), np.add.reduceat(tf, first) if len(first) else tf
                named, names = list(groups), pa.array(list(number), pa.binary()).cast(pa.string())
                of, term = np.divmod(ids[first], max(len(number), 1))
                per_group = np.bincount(group, minlength=len(groups))
                langs, sources = (pa.array([g[i] for g in named], pa.string()) for i in (0, 1))
                both = pa.array(np.concatenate([of, np.arange(len(named))]))
                terms = pa.concat_arrays([names.take(pa.array(term)), pa.nulls(len(named), pa.string())])
                columns = [langs.take(both), terms, sources.take(both), pa.array(np.full(len(both), document)), pa.array(np.concatenate([df, per_group])), pa.array(np.concatenate([n, np.zeros(len(named), np.int64)]))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "source", "document", "df", "n"])
                document += 1

    read = docs.select(
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"),
        *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))),
    )
    return read.mapInArrow(run, "lang string, term string, source string, document long, df long, n long")


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal values begin in sorted columns."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new) > 1:
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _numbered(column: pa.Array) -> np.ndarray:
    """Numbers that are equal where strings are; no term is empty, so null counts as that."""
    return pc.fill_null(column, "").dictionary_encode().indices.to_numpy()


def by_runs(batches: Iterator[pa.RecordBatch], keys: int, fold, finish) -> Iterator[pa.RecordBatch]:
    """``finish`` of the whole runs of sorted batches; of the last run of a batch only what ``fold`` leaves is held.

    Both get a batch and where the runs of its first ``keys`` columns begin.
    """
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        first = _starts([_numbered(batch.column(i)) for i in range(keys)])
        if len(first) > 1:
            yield finish(batch.slice(0, first[-1]), first[:-1])
        held = fold(batch.slice(first[-1]), np.zeros(1, dtype=np.int64))
    if held is not None:
        yield finish(held, np.zeros(1, dtype=np.int64))


def scan_runs(rows: DataFrame) -> DataFrame:
    """``lang, term, source, df, n`` added up over documents: dealt by the three, sorted by them and the document, scanned."""

    def added(batch: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
        sums = [pa.array(np.add.reduceat(batch.column(i).to_numpy(), first)) for i in (4, 5)]
        return pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(first)) for i in range(4)), *sums], schema=batch.schema)

    keys = ["lang", "term", "source"]
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "document").select(*keys, "document", "df", "n")
    kinds = "lang string, term string, source string, document long, df long, n long"
    return ordered.mapInArrow(lambda batches: by_runs(batches, 3, added, added), kinds).drop("document")


def kept_terms(runs: DataFrame, min_docs: int) -> DataFrame:
    """``lang, term, sources, counts`` of terms in at least ``min_docs`` documents of their language: dealt by both, sorted with the source, scanned."""

    def lists(batch: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
        ends = np.append(first, batch.num_rows)
        keep = np.flatnonzero(np.add.reduceat(batch.column(3).to_numpy(), first) >= min_docs)
        sizes = np.diff(ends)[keep]
        at = np.repeat(ends[keep] - np.append(0, np.cumsum(sizes))[:-1], sizes) + np.arange(sizes.sum())
        offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        heads = [batch.column(i).take(pa.array(first[keep])) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*heads, *(pa.ListArray.from_arrays(offsets, batch.column(i).take(pa.array(at))) for i in (2, 4))], names=["lang", "term", "sources", "counts"])

    ordered = runs.where("term IS NOT NULL").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    kinds = "lang string, term string, sources array<string>, counts array<long>"
    return ordered.mapInArrow(lambda batches: by_runs(batches, 2, lambda tail, _: tail, lists), kinds)


def partial_results(kept: DataFrame, shared, k: int, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """``lang, source, part, item, value``: by task the sums for pairs of sources and the terms that may be among the ``k`` first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value  # lang -> (sources, totals, kept terms)
        places = {lang: {s: i for i, s in enumerate(x[0])} for lang, x in known.items()}
        sums: dict[str, np.ndarray] = {}
        best: dict[str, np.ndarray] = {}

        def rows(lang: str, part: str, source: np.ndarray, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
            same = [pa.array([x] * len(value), pa.string()) for x in (lang, part)]
            columns = [same[0], pa.array(known[lang][0], pa.string()).take(pa.array(source)), same[1], item, pa.array(value)]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "part", "item", "value"])

        def pairs(lang: str, matrix: np.ndarray) -> pa.RecordBatch:
            a, b = np.nonzero(matrix)
            return rows(lang, "pair", a, pa.array(known[lang][0], pa.string()).take(pa.array(b)), matrix[a, b])

        for batch in batches:
            of = np.asarray(batch.column(0).to_pylist(), dtype=object)
            for lang in dict.fromkeys(of.tolist()):
                sources, totals, n_kept = known[lang]
                many = len(sources)
                mine = batch.take(pa.array(np.flatnonzero(of == lang)))
                step = max(1, held_pairs // many // 4)
                for at in range(0, mine.num_rows, step):
                    part = mine.slice(at, step)
                    part = part.take(pc.sort_indices(part.column(1)))  # by the bytes of UTF-8
                    counts = np.zeros((part.num_rows, many), dtype=np.int64)
                    column = np.asarray([places[lang][s] for s in pc.list_flatten(part.column(2)).to_pylist()], dtype=np.int64)
                    counts[np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(2)).to_numpy()), column] = pc.list_flatten(part.column(3)).to_numpy()
                    p = shares(counts, totals[None, :], n_kept)
                    q = shares(counts.sum(axis=1), totals.sum(), n_kept)[:, None]
                    matrix = sums.setdefault(lang, np.zeros((many, many), dtype=np.int64)) if many * many <= held_pairs else None
                    for a in range(many - 1):
                        both = divergence(p[:, a : a + 1], p[:, a + 1 :]).sum(axis=0)
                        if matrix is not None:
                            matrix[a, a + 1 :] += both
                        else:
                            b = np.flatnonzero(both)
                            yield rows(lang, "pair", np.full(len(b), a), pa.array([sources[a + 1 + i] for i in b], pa.string()), both[b])
                    values = np.where((counts > 0) & (p > q), divergence(p, q), -1)
                    top = best.setdefault(lang, np.full((many, k), -1, dtype=np.int64))
                    for s in range(many):
                        first = leading(values[:, s], k, max(0, int(top[s, 0])))
                        if len(first):
                            top[s] = np.sort(np.concatenate([top[s], values[first, s]]))[-k:]
                            yield rows(lang, "term", np.full(len(first), s), part.column(1).take(pa.array(first)), values[first, s])
        for lang, matrix in sums.items():
            yield pairs(lang, matrix)

    return kept.mapInArrow(run, "lang string, source string, part string, item string, value long")


def audit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = 10,
    k: int = 10,
    block_bytes: int = 8 << 20,
    slice_bytes: int = 32 << 20,
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (language, source) that occurs.

    Part ``pair`` has every other source of the language with their divergence, summed over the language's kept terms;
    part ``term`` the ``k`` terms that a source has more of than its language and that diverge most from it. Ranks are by
    value, descending, then by item.

    Each row is a document, also where it repeats. Null texts, languages and sources are empty ones; a source whose texts
    have no term takes part with counts of 0; without kept terms all pairs have the value 0 and there are no terms.
    An empty table gives no rows; further columns are ignored; names may clash. All sums are exact in 64 bits.

    Documents are counted in blocks of ``block_bytes`` of text (or one longer text) before anything is shuffled. What the
    driver broadcasts is the sources of at most ``slice_bytes`` of language and source names at a time (of one language
    at least), never terms; kept terms are read again for each further slice.
    """
    spark = docs.sparkSession
    runs = durable(scan_runs(local_runs(docs, text_col, lang_col, source_col, block_bytes)))
    kept = durable(kept_terms(runs, min_docs))
    entries = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    counted = entries.groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    groups = runs.where("term IS NULL").select("lang", "source").join(counted, ["lang", "source"], "left")
    groups = durable(groups.join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), "v"))
    size = groups.agg(F.coalesce(F.sum(F.octet_length("lang") + F.octet_length("source") + 64), F.lit(0))).first()[0]
    slices = max(1, -(-size // slice_bytes))
    number = F.pmod(F.xxhash64("lang"), F.lit(slices))
    found = None
    for s in range(slices):
        known: dict[str, tuple] = {}
        for r in groups.where((number == s) & F.col("v").isNotNull()).sort("lang", "source").toLocalIterator():
            names, totals, _ = known.setdefault(r["lang"], ([], [], r["v"]))
            names.append(r["source"])
            totals.append(r["n"])
        shared = spark.sparkContext.broadcast({lang: (names, np.asarray(totals, dtype=np.int64), v) for lang, (names, totals, v) in known.items()})
        part = partial_results(kept.where(number == s), shared, k)
        found = part if found is None else found.unionByName(part)
    found = durable(found)
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    # pairs that never differ have no partial sum
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return pairs.withColumn("rank", rank).unionByName(found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= k))
