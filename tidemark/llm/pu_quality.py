"""Quality by positive-unlabelled learning: a small network that minimises the non-negative unbiased PU risk.

Trusted positives are rows labelled 1; unlabelled rows are web texts whatever their label. With class prior p, loss l and
scores g, the risk is p * E_P[l(g, +)] + max(0, E_U[l(g, -)] - p * E_P[l(g, -)]); when the second part falls below zero,
the step goes the other way, which keeps the network from memorising the positives. The prior is the labels' own share of
ones, or estimated from positives alone where there are no zeros.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.language_id import learnable

#: Positives, and unlabelled texts, that are drawn for fitting at most.
SAMPLE = 6000
#: Names of what is measured in a whole text, in order.
MEASURES = (
    "log_words", "word_length", "distinct_words", "most_frequent_word", "repeated_neighbours", "capitals", "digits", "marks",
    "symbols", "paired_marks", "bars", "lines_per_word", "distinct_lines", "short_words", "long_words", "high_bytes", "trigram_spread",
)

#: Places that hashed words, and hashed runs of three bytes, are counted in, beside the measures.
HASHED = 128

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?;:,.\"'()-"]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True


def measure(text: str | None) -> np.ndarray:
    """The measures of a whole text, then square roots of the shares of its hashed words and runs of three bytes; all 0 without words."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros(len(MEASURES) + 2 * HASHED, dtype=np.float64)
    x = np.frombuffer(raw, np.uint8)
    hist = np.bincount(x, minlength=256)
    letters = hist[_UPPER].sum() + hist[_LOWER].sum()
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    again = sum(map(bytes.__eq__, words, words[1:]))
    marks = _MARK | _SYMBOL
    pairs = int((marks[x[1:]] & (x[1:] == x[:-1])).sum())
    lines = [line for line in raw.split(b"\n") if line.strip()]
    inside = max(len(raw) - 2, 0)
    spread, runs = 0.0, np.zeros(HASHED)
    if inside:
        y = x.astype(np.uint32)
        code = ((y[:-2] << np.uint32(16)) | (y[1:-1] << np.uint32(8)) | y[2:]) * np.uint32(0x9E3779B1) >> np.uint32(20)
        seen = np.bincount(code, minlength=4096)
        share = seen[seen > 0] / inside
        runs = np.sqrt(seen.reshape(HASHED, -1).sum(axis=1) / inside)
        spread = float(-(share * np.log2(share)).sum()) / max(1.0, np.log2(min(inside, 4096)))
    kinds = np.fromiter(map(crc32, counts), np.int64, len(counts)) % HASHED
    named = np.sqrt(np.bincount(kinds, weights=np.fromiter(counts.values(), np.int64, len(counts)), minlength=HASHED) / n)
    surface = np.asarray([
        np.log(n), sizes.mean(), len(counts) / n, max(counts.values()) / n, again / max(n - 1, 1), hist[_UPPER].sum() / max(letters, 1), hist[_DIGIT].sum() / len(x), hist[_MARK].sum() / n,
        hist[_SYMBOL].sum() / n, pairs / n, hist[ord("|")] / n, len(lines) / n, len(set(lines)) / max(len(lines), 1), (sizes <= 2).mean(), (sizes >= 15).mean(), hist[128:].sum() / len(x), spread,
    ])
    return np.concatenate([surface, named, runs])


@dataclass
class Network:
    """One hidden layer over standardised measures; ``scores`` gives probabilities."""

    mean: np.ndarray
    std: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        g = np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def fit_network(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 32, epochs: int = 120, batch: int = 512, rate: float = 3e-3, seed: int = 5) -> Network:
    """Minimises the non-negative PU risk with the logistic loss by Adam."""
    rng = np.random.default_rng(seed)
    mean, std = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    p, u = (np.clip((x - mean) / std, -8, 8) for x in (positive, unlabelled))
    params = [rng.standard_normal((p.shape[1], hidden)) * np.sqrt(2 / p.shape[1]), np.zeros(hidden), rng.standard_normal(hidden) * np.sqrt(1 / hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in params], [np.zeros_like(w) for w in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(u))
        for at in range(0, len(u), batch):
            bu, bp = u[order[at : at + batch]], p[rng.integers(0, len(p), batch)]
            x = np.vstack([bp, bu])
            h = x @ params[0] + params[1]
            a = np.maximum(h, 0)
            g = a @ params[2] + params[3]
            s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            np_, nu = len(bp), len(bu)
            as_negative = np.logaddexp(0, g)
            rest = as_negative[np_:].mean() - prior * as_negative[:np_].mean()
            dg = np.zeros(len(x))
            if rest >= 0:
                dg[:np_] = prior * (s[:np_] - 1) / np_ - prior * s[:np_] / np_
                dg[np_:] = s[np_:] / nu
            else:  # the other way, on the part that fell below zero
                dg[:np_] = prior * s[:np_] / np_
                dg[np_:] = -s[np_:] / nu
            dh = np.outer(dg, params[2]) * (h > 0)
            grads = [x.T @ dh + 1e-4 * params[0], dh.sum(axis=0), a.T @ dg + 1e-4 * params[2], np.asarray([dg.sum()])]
            step += 1
            for k, d in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                params[k] = params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, std, params[0], params[1], params[2], float(params[3][0]))


def _measured(docs: DataFrame, kept: list[str], text_col: str) -> DataFrame:
    """Columns ``kept`` and ``x``, the measures, as array<double>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [measure(t.as_py()) for t in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(x, pa.list_(pa.float64()))], names=[*kept, "x"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in kept)
    return docs.select(*kept, F.col(text_col).alias("_text")).mapInArrow(run, f"{kinds}, x array<double>")


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.2) -> float:
    """The share of positives among unlabelled rows, from positives alone.

    No region holds a smaller share of the unlabelled rows than the prior times that of the positives. A network is fitted
    on one half of both; on the other half the regions above each of its scores that hold ``least`` or more of the positives
    are tried, and the smallest ratio of shares, corrected for the number of rows, is the prior.
    """
    net = fit_network(positive[::2], unlabelled[::2], 0.5, epochs=40)
    p, u = (np.sort(net.scores(x[1::2] if len(x) > 1 else x)) for x in (positive, unlabelled))
    share_p, share_u = (1 - np.searchsorted(x, p, side="left") / len(x) for x in (p, u))
    near = share_p >= least
    slack = np.sqrt(share_u * (1 - share_u) / len(u)) + 1 / len(u)
    return float(np.clip(((share_u + slack) / share_p)[near].min(initial=1.0), 0.02, 0.98))


def drawn(docs: DataFrame, named: DataFrame, id_col: str, sample: int) -> DataFrame:
    """``_id, _positive``: at most ``sample`` distinct ids of positives, and of any documents, least by a hash of them."""
    ids = docs.where(learnable(id_col)).select(F.col(id_col).alias("_id")).distinct()
    trusted = ids.join(named.where("_label = 1").select(F.col(id_col).alias("_id")), "_id", "left_semi")
    sides = [some.orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(sample).select("_id", F.lit(positive).alias("_positive")) for some, seed, positive in ((trusted, 3, True), (ids, 4, False))]
    return sides[0].unionByName(sides[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, prior: float | None = None) -> Network | None:
    """A network from at most ``sample`` trusted positives and ``sample`` unlabelled texts, drawn by a hash of their distinct ids.

    Only rows that ``learnable`` allows are used; of rows that repeat an id the smallest text is. ``prior``, the share of
    good texts among all, is the share of ones among the labels if it is not given, and ``estimated_prior`` where no label
    is 0. None without positives.
    """
    named = labels.where(learnable(id_col) & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("_label"))
    if prior is None:
        share = named.agg(F.avg(F.col("_label").cast("double"))).first()[0]
        prior = min(max(share, 0.02), 0.98) if share is not None and share < 1 else None
    ids = drawn(docs, named, id_col, sample)  # at most twice the sample
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text2")).join(F.broadcast(ids), "_id")
    texts = texts.groupBy("_id", "_positive").agg(F.min("_text2").alias("_text2"))  # one text of each id, however often it repeats
    rows = _measured(texts, ["_id", "_positive"], "_text2").collect()
    rows.sort(key=lambda r: (r[1], r[0], r[2]))
    p, u = (np.asarray([r[2] for r in rows if r[1] is side], dtype=np.float64) for side in (True, False))
    if not len(p) or not len(u):
        return None
    return fit_network(p, u, estimated_prior(p, u) if prior is None else prior)


def score(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``id_col, score, predicted`` of every whole text; without a network the score is 0.5.

    Only the text is looked at; null, empty and blank texts are measured as zeros and scored as such. An empty table gives
    no rows; repeated ids give a row each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray([measure(t.as_py()) for t in batch.column(1)], dtype=np.float64).reshape(batch.num_rows, len(MEASURES) + 2 * HASHED)
            s = network.scores(x) if network else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
