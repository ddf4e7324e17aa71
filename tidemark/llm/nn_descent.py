"""Near-duplicate vectors by NN-descent: a neighbour graph that is refined by joining neighbours of neighbours.

Vectors are compared only within their label. The graph starts from neighbours along random projections. Each round, every
vector gathers itself, its neighbours and those that have it as a neighbour, compares them with each other in one local
matrix product, and offers each the best of the others; the best ``k`` offers stay. Rounds work on unit vectors in half
precision, whose cosines are off by less than ``MARGIN``; what comes that near to the threshold is held against it in double
precision. Vectors whose whole list links are
saturated: all of their connected group are compared with their whole label, in tiles of bounded size. What reaches the
threshold is an edge. Equal vectors take part as one, with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import components, durable, join_spread

#: Vectors on a side of a tile.
TILE = 2048
#: Share of new links at which rounds end, and rounds at most.
SETTLED, ROUNDS = 0.001, 12
#: More than two unit vectors' cosine is off by when both are rounded to half precision (at most 2 ** -10 and a little more).
MARGIN = 0.002
#: Vectors whose surroundings are compared at once.
CENTERS = 512


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``_id, _label, _v``: rows with an id, a label and a vector, as array<double>, whose length is finite and above 0."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("_v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("string").alias("_label"), v.alias("_v")).where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & F.col("_v").isNotNull()).where(good)


def unit(rows: list | np.ndarray) -> np.ndarray:
    """Rows at length one, scaled first so that very large and very small components neither overflow nor vanish."""
    x = np.stack(rows).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def initial_graph(points: DataFrame, k: int, lines: int, seed: int) -> DataFrame:
    """``_id, _other`` pairs of vectors that lie side by side in their label along random projections.

    Each projection is sorted within ranges by Spark; a vector is paired with the next ``k // 2`` of its range.
    """

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["_v"].map(len).to_numpy()
            out = []
            for size in np.unique(sizes):
                part = batch[sizes == size]
                z = unit(part["_v"].tolist()) @ np.random.default_rng([seed, int(size)]).standard_normal((int(size), lines))
                for j in range(lines):
                    out.append(pd.DataFrame({"_line": j, "_label": part["_label"], "_size": int(size), "_z": z[:, j], "_id": part["_id"]}))
            if out:
                yield pd.concat(out)

    placed = points.mapInPandas(project, "_line int, _label string, _size int, _z double, _id long")
    ordered = placed.repartitionByRange("_line", "_label", "_size", "_z", "_id").sortWithinPartitions("_line", "_label", "_size", "_z", "_id")

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for batch in batches:
            frame = batch if tail is None else pd.concat([tail, batch], ignore_index=True)
            fresh = 0 if tail is None else len(tail)
            ids, group = frame["_id"].to_numpy(), pd.util.hash_pandas_object(frame[["_line", "_label", "_size"]], index=False).to_numpy()
            a, b = [], []
            for step in range(1, max(1, k // 2) + 1):
                same = np.flatnonzero(group[step:] == group[:-step])
                same = same[same + step >= fresh]
                a.append(ids[same])
                b.append(ids[same + step])
            yield pd.DataFrame({"_id": np.concatenate(a), "_other": np.concatenate(b)})
            tail = frame.iloc[-max(1, k // 2) :]

    return ordered.mapInPandas(pair, "_id long, _other long").where("_id <> _other").distinct()


def halved(points: DataFrame) -> DataFrame:
    """``_id, _b``: unit vectors in half precision, as bytes."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_id": batch["_id"], "_b": [unit([v])[0].astype("<f2").tobytes() for v in batch["_v"]]})

    return points.select("_id", "_v").mapInPandas(pack, "_id long, _b binary")


def met_around(ids: np.ndarray, starts: np.ndarray, vectors: list[np.ndarray], worst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``id, other, similarity``: for each vector of a group its ``k`` best others there, as far as they are better than its ``worst``.

    Group ``i`` is ``ids[starts[i]:starts[i + 1]]``, its vectors (in half precision) are ``vectors[i]``. Groups of equal size and dimension are compared together.
    """
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, x in enumerate(vectors):
        if len(x) > 1:
            kinds.setdefault(x.shape, []).append(i)
    found = [(ids[:0], ids[:0], worst[:0])]
    for (n, _), groups in kinds.items():
        for low in range(0, len(groups), CENTERS):
            some = groups[low : low + CENTERS]
            x = np.stack([vectors[i] for i in some]).astype(np.float32)
            at = starts[some][:, None] + np.arange(n)
            similar = x @ x.transpose(0, 2, 1)
            similar[:, np.arange(n), np.arange(n)] = -2
            take = min(k, n - 1)
            best = np.argpartition(-similar, take - 1, axis=2)[:, :, :take]
            values = np.take_along_axis(similar, best, axis=2).astype(np.float64)
            group, row, column = np.nonzero(values > worst[at][:, :, None])
            found.append((ids[at[group, row]], ids[at[group, best[group, row, column]]], values[group, row, column]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def refine(packed: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """One round: ``_id, _other, _sim`` of the best ``k`` neighbours of each vector among those of ``graph`` and those met around any vector.

    ``packed`` are ``halved`` vectors. Once ``graph`` has similarities, only what is better than a vector's worst neighbour is offered.
    """
    both = graph.select("_id", "_other").unionByName(graph.select(F.col("_other").alias("_id"), F.col("_id").alias("_other"))).repartition("_id").distinct()
    # those around a vector: by a hash of the pair at most 2k reach it, for this round
    around = both.withColumn("_n", F.row_number().over(W.partitionBy("_id").orderBy(F.xxhash64("_id", "_other")))).where(F.col("_n") <= 2 * k).select(F.col("_id").alias("_center"), F.col("_other").alias("_id"))
    around = around.unionByName(packed.select(F.col("_id").alias("_center"), "_id"))
    known = "_sim" in graph.columns
    worst = F.when(F.count("*") >= k, F.min("_sim")).otherwise(-2.0).alias("_worst")
    own = packed.join(graph.groupBy("_id").agg(worst), "_id", "left") if known else packed.withColumn("_worst", F.lit(-2.0))
    gathered = around.join(own.withColumn("_worst", F.coalesce("_worst", F.lit(-2.0))), "_id").groupBy("_center").agg(F.collect_list(F.struct("_id", "_b", "_worst")).alias("_met"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = batch.column("_met")
            inner, starts = met.flatten(), np.asarray(met.offsets, dtype=np.int64) - met.offsets[0].as_py()
            ids, held, worst = np.asarray(inner.field("_id")), inner.field("_b"), np.asarray(inner.field("_worst"))
            ends = np.frombuffer(held.buffers()[1], dtype=np.int32)[held.offset : held.offset + len(held) + 1]
            numbers = np.frombuffer(held.buffers()[2], dtype="<f2")
            vectors = [numbers[ends[a] // 2 : ends[b] // 2].reshape(b - a, -1) for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False)]
            a, b, similar = met_around(ids, starts, vectors, worst, k)
            # a pair that is met around several vectors is offered once
            order = np.lexsort((-similar, b, a))
            first = order[np.flatnonzero(np.diff(a[order], prepend=-1) | np.diff(b[order], prepend=-1))] if len(order) else order
            yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(similar[first])], names=["_id", "_other", "_sim"])

    offers = gathered.select("_met").mapInArrow(meet, "_id long, _other long, _sim double")
    if known:
        offers = offers.unionByName(graph.select("_id", "_other", "_sim"))
    offers = offers.repartition("_id").groupBy("_id", "_other").agg(F.max("_sim").alias("_sim"))  # once for the group and the window
    rank = W.partitionBy("_id").orderBy(F.desc("_sim"), "_other")
    return offers.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= k).select("_id", "_other", "_sim")


def verified(points: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Of ``a, b`` those whose vectors have a cosine of at least ``threshold`` in double precision."""
    side = lambda n: points.select(F.col("_id").alias(n), F.col("_v").alias(f"_{n}"))

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = [np.dot(unit([x])[0], unit([y])[0]) >= threshold for x, y in zip(batch["_a"], batch["_b"], strict=True)]
            yield batch.loc[np.asarray(kept, dtype=bool), ["a", "b"]]

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(hold, "a long, b long")


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a symmetric matrix of links those ``i, j`` that make a spanning forest."""
    left, a, b = np.ones(len(linked), bool), [], []
    for root in range(len(linked)):
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


def tiles(points: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """What the vectors ``asked`` (``_id``) link with among all of their label.

    Rows with ``_links``: for ``_id`` in ``asked`` the weights of all that it links with, for others of all in ``asked``
    that they link with. Rows with ``_other``: links that connect what is linked. ``points`` has ``_id, _label, _v, _w``.

    Both sides are cut into tiles of at most ``TILE`` vectors by a hash; each pair of tiles is one task's matrix product,
    so no label meets in one task. A vector travels once for each tile of the other side in its label.
    """
    mine = points.join(asked.select("_id", F.lit(True).alias("_asked")), "_id", "left").withColumn("_asked", F.coalesce("_asked", F.lit(False)))
    cut = lambda n: F.ceil(n / (0.8 * TILE)).cast("int")
    sized = mine.groupBy("_label").agg(cut(F.count("*")).alias("_cols"), cut(F.count(F.when(F.col("_asked"), 1))).alias("_rows")).where("_rows > 0")
    dealt = mine.join(sized, "_label")
    place = lambda n: F.pmod(F.xxhash64("_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["_id", "_label", "_v", "_w", "_asked"]
    rows = dealt.where("_asked").select(*columns, place("_rows").alias("_row"), each("_cols").alias("_col"), F.lit(True).alias("_is_row"))
    cols = dealt.select(*columns, each("_rows").alias("_row"), place("_cols").alias("_col"), F.lit(False).alias("_is_row"))

    def product(part: pd.DataFrame) -> pd.DataFrame:
        is_row = part["_is_row"].to_numpy()
        a, b = part[is_row], part[~is_row]
        if not len(a) or not len(b):
            return pd.DataFrame({"_id": [], "_other": [], "_links": []})
        x, y, ia, ib = unit(a["_v"].tolist()), unit(b["_v"].tolist()), a["_id"].to_numpy(), b["_id"].to_numpy()
        linked = (x @ y.T >= threshold) & (ia[:, None] != ib[None, :])
        number = linked.astype(np.float64)
        new = ~b["_asked"].to_numpy()
        square = np.zeros((len(a) + len(b),) * 2, bool)
        square[: len(a), len(a) :], square[len(a) :, : len(a)] = linked, linked.T
        i, j = forest(square)
        both = np.concatenate([ia, ib])
        frame = pd.concat([
            pd.DataFrame({"_id": ia, "_links": number @ b["_w"].to_numpy(np.float64)}),
            pd.DataFrame({"_id": ib[new], "_links": a["_w"].to_numpy(np.float64) @ number[:, new]}),
            pd.DataFrame({"_id": both[i], "_other": both[j], "_links": 0}),
        ])
        return frame.astype({"_other": "Int64", "_links": "int64"})[(frame["_links"] > 0) | frame["_other"].notna()][["_id", "_other", "_links"]]

    return rows.unionByName(cols).groupBy("_label", "_row", "_col").applyInPandas(product, "_id long, _other long, _links long")


def neighbour_links(points: DataFrame, threshold: float, k: int = 16, rounds: int = ROUNDS, lines: int = 4, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Edges ``a, b`` at the threshold found by NN-descent, and ``_id`` of the vectors whose lists are saturated: full of what is that near, or nearly.

    Rounds go on until one adds less than ``SETTLED`` of the links at the threshold.
    """
    graph, packed = durable(initial_graph(points, k, lines, seed)), durable(halved(points))
    before, close = None, threshold - MARGIN
    for _ in range(rounds):
        graph = durable(refine(packed, graph, k))
        now = graph.where(F.col("_sim") >= close).count()
        if before is not None and now - before <= SETTLED * now:
            break
        before = now
    linked = graph.where(F.col("_sim") >= close) if "_sim" in graph.columns else graph.where("false")
    saturated = linked.groupBy("_id").count().where(F.col("count") >= k).select("_id")
    pairs = durable(linked.select(F.least("_id", "_other").alias("a"), F.greatest("_id", "_other").alias("b")).distinct())
    return verified(points, pairs, threshold), saturated


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, k: int = 16, rounds: int = ROUNDS) -> DataFrame:
    """One row per vector: ``id_col, n_links, component_id, kept``.

    Vectors of one label with cosine at least ``threshold`` in double precision are linked. Null, empty and zero vectors,
    vectors with null or non-finite components, and rows without a label or id link with nothing: they have 0 links and
    are their own component. Vectors of different lengths have no cosine and are never linked. Ids are taken to be unique;
    rows that repeat one count once as a vector and are returned each. An empty table gives no rows; other columns are
    ignored. Links found are exact; a link is missed only if
    NN-descent didn't meet it and neither end's group has a saturated list.
    """
    points = usable(vectors, id_col, vector_col, label_col).dropDuplicates(["_id"])
    points = durable(points.withColumn("_label", F.concat_ws("/", "_label", F.size("_v").cast("string"))).repartition("_id"))
    # equal vectors are one, with a weight
    same = durable(points.groupBy("_label", "_v").agg(F.min("_id").alias("_id"), F.count("*").alias("_w")))
    edges, saturated = neighbour_links(same.select("_id", "_label", "_v"), threshold, k, rounds)
    edges = durable(edges)
    groups = durable(components(edges))
    full = groups.join(saturated, groups["node"] == saturated["_id"], "left_semi").select("component").distinct()
    # lists that aren't saturated hold all links found; groups with saturated ones are held against their whole label
    asked = durable(groups.join(full, "component", "left_semi").select(F.col("node").alias("_id")).unionByName(saturated).distinct())
    met = durable(tiles(same, asked, threshold))
    groups = durable(components(edges.unionByName(met.where("_other is not null").select(F.col("_id").alias("a"), F.col("_other").alias("b")))))
    pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    listed = pairs.join(asked, pairs["a"] == asked["_id"], "left_anti").join(asked, pairs["b"] == asked["_id"], "left_anti")
    listed = listed.join(same.select(F.col("_id").alias("b"), F.col("_w").alias("_links")), "b").select(F.col("a").alias("_id"), "_links")
    counts = met.where("_other is null").select("_id", "_links").unionByName(listed).groupBy("_id").agg(F.sum("_links").alias("_links"))
    named = same.join(groups.select(F.col("node").alias("_id"), "component"), "_id", "left").join(counts, "_id", "left")
    named = durable(named.select("_label", "_v", "_w", F.coalesce("component", "_id").alias("_component"), (F.coalesce("_links", F.lit(0)) + F.col("_w") - 1).alias("_count")))
    total = points.count()
    named = join_spread(points, named, ["_label", "_v"], "_w", total).select(F.col("_id").alias("_key"), "_component", "_count")
    out = vectors.select(id_col).join(named, F.col(id_col).cast("long") == F.col("_key"), "left")
    component = F.coalesce("_component", F.col(id_col).cast("long"))
    return out.select(id_col, F.coalesce("_count", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col(id_col).cast("long") == component).alias("kept"))


def audit_recall(vectors: DataFrame, result: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, block: int = 2000) -> DataFrame:
    """One row, ``queries, links, found, recall``: links of every vector whose id is divisible by 100, held against all vectors.

    Queries are compared by brute force with all rows, in blocks of queries; ``found`` adds the links that ``result``
    counts for them; ``recall`` is null where there is no link to find.
    """
    points = usable(vectors, id_col, vector_col, label_col)
    queries = points.where(F.col("_id") % 100 == 0)
    blocks = max(1, -(-queries.count() // block))
    asked = queries.groupBy(F.pmod(F.xxhash64("_id"), F.lit(blocks)).alias("_block")).agg(F.collect_list(F.struct("_id", "_label", "_v")).alias("_asked"))
    total = None
    for b in range(blocks):
        held = F.broadcast(asked.where(F.col("_block") == b).select("_asked"))

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 500):
                    part = batch.iloc[at : at + 500]
                    asked_rows = part["_asked"].iloc[0]
                    ids, labels = np.asarray([r["_id"] for r in asked_rows]), np.asarray([r["_label"] for r in asked_rows])
                    sizes = part["_v"].map(len).to_numpy()
                    found = np.zeros(len(ids), np.int64)
                    for size in np.unique(sizes):
                        mine = np.flatnonzero([len(r["_v"]) == size for r in asked_rows])
                        if len(mine):
                            some = part[sizes == size]
                            sim = unit([asked_rows[i]["_v"] for i in mine]) @ unit(some["_v"].tolist()).T
                            hit = (sim >= threshold) & (labels[mine][:, None] == some["_label"].to_numpy()[None, :]) & (ids[mine][:, None] != some["_id"].to_numpy()[None, :])
                            found[mine] += hit.sum(axis=1)
                    yield pd.DataFrame({"_id": ids, "_true": found})

        part = points.join(held).mapInPandas(compare, "_id long, _true long").groupBy("_id").agg(F.sum("_true").alias("_true"))
        total = part if total is None else total.unionByName(part)
    both = total.join(result.select(F.col(id_col).cast("long").alias("_id"), "n_links"), "_id")
    sums = both.agg(F.count("*").alias("queries"), F.sum("_true").alias("links"), F.sum(F.least("n_links", "_true")).alias("found"))
    return sums.withColumn("recall", F.try_divide("found", "links"))
