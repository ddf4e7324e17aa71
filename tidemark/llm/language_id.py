"""Language identification in two steps: the language family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable

#: Hash buckets of byte trigrams.
DIMS = 1 << 13
#: Labelled documents drawn for each language at most, and for all together; the only sample that is taken.
PER_LANGUAGE, IN_ALL = 300, 20_000
#: Bytes of a text that are counted at a time.
CHUNK = 1 << 20
#: Families of languages by ISO 639-1 code. A language outside the table is a family by itself.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr sl bs",
    "indic": "hi bn mr gu pa ur ne si",
    "turkic": "tr az kk uz ky tk tt",
    "uralic": "fi et hu",
    "semitic": "ar he am mt",
    "iranian": "fa ps ku tg",
    "dravidian": "ta te kn ml",
    "malayic": "id ms jv su tl",
    "sinitic": "zh yue",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_KEEP = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def trigrams(text: str) -> tuple[np.ndarray, int]:
    """Counts of hashed byte trigrams of a whole text, lower-cased, all but letters blanked; and how many there are."""
    raw = f" {text.lower()} ".encode().translate(_KEEP)
    counts = np.zeros(DIMS, dtype=np.int64)
    for at in range(0, max(1, len(raw) - 2), CHUNK):
        x = np.frombuffer(raw, np.uint8, min(CHUNK + 2, len(raw) - at), at).astype(np.uint32)
        code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
        code = code[code != 0x202020]
        counts += np.bincount((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13), minlength=DIMS)
    return counts, int(counts.sum())


def features(text: str) -> np.ndarray:
    """Square roots of trigram shares: a vector of length one."""
    counts, n = trigrams(text)
    return np.sqrt(counts / max(n, 1)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 60) -> np.ndarray:
    """Weights (the last is the bias) of an L2-regularised squared-hinge SVM for labels +1 and -1, classes weighted alike.

    Newton's method on the dual's examples: each round solves the least-squares problem of the examples inside the margin.
    """
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64)
    c = cost * np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y)
    gram = x @ x.T
    alpha = np.zeros(len(y))
    active = np.ones(len(y), dtype=bool)
    for _ in range(rounds):
        part = gram[np.ix_(active, active)] + np.diag(1 / c[active])
        alpha = np.zeros(len(y))
        alpha[active] = np.linalg.solve(part, y[active])
        now = y * (gram @ alpha) < 1
        if (now == active).all() or not now.any():
            break
        active = now
    return x.T @ alpha


@dataclass
class Machine:
    """One-versus-one votes between names; ``weights`` has a row for each pair."""

    names: list[str]
    weights: np.ndarray

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        """The name with most votes (then the largest sum of margins, then the first), and a confidence from 0 to 1."""
        if len(self.names) == 1:
            return self.names[0], 1.0
        margin = self.weights[:, :-1] @ v + self.weights[:, -1]
        votes, sums, least = np.zeros(len(self.names)), np.zeros(len(self.names)), np.full(len(self.names), np.inf)
        for (i, j), m in zip(combinations(range(len(self.names)), 2), margin, strict=True):
            votes[i if m >= 0 else j] += 1
            sums[i] += m
            sums[j] -= m
            least[i], least[j] = min(least[i], m), min(least[j], -m)
        best = max(range(len(self.names)), key=lambda k: (votes[k], sums[k], -k))
        return self.names[best], float(1 / (1 + np.exp(-4 * np.clip(least[best], -10, 10))))


def fit_machine(x: np.ndarray, labels: np.ndarray) -> Machine:
    names = sorted(set(labels))
    rows = []
    for a, b in combinations(names, 2):
        some = (labels == a) | (labels == b)
        rows.append(linear_svm(x[some], np.where(labels[some] == a, 1.0, -1.0)))
    return Machine(names, np.asarray(rows, dtype=np.float32).reshape(len(rows), x.shape[1] + 1))


@dataclass
class Model:
    """The machine between families and one within each family."""

    family: Machine
    within: dict[str, Machine]

    def predict(self, text: str) -> tuple[str, float]:
        v = features(text)
        family, sure = self.family.predict(v)
        language, surer = self.within[family].predict(v)
        return language, sure * surer


def learnable(id_col: str) -> Column:
    """Whether a row may be learnt from: crc32 of its id as text, mod 5, is not 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 != 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> Model | None:
    """A model from at most ``per_language`` labelled documents of each language and ``in_all`` of all, drawn by a hash.

    None if no document has a language and a letter. Of each language those documents are drawn whose hash of id and text
    lies below a bound, so that half as many again as wanted are in the mean; those of lowest hash are used. Rows that repeat
    id and text count once.
    """
    labelled = docs.where(learnable(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    labelled = labelled.select(F.xxhash64(id_col, text_col).alias("_hash"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    sizes = durable(labelled.groupBy("_lang").agg(F.approx_count_distinct("_hash").alias("_size")))
    most = F.least(F.lit(per_language), F.greatest(F.lit(1), F.lit(in_all) / F.col("_languages")))
    share = F.least(F.lit(1.0), (1.5 * most + 20) / F.col("_size"))
    bounds = sizes.join(F.broadcast(sizes.agg(F.count("*").alias("_languages")))).select("_lang", share.alias("_share"), most.cast("int").alias("_most"))
    unit = F.shiftrightunsigned("_hash", 11) / float(1 << 53)
    texts = labelled.join(F.broadcast(bounds), "_lang").where(unit < F.col("_share")).dropDuplicates(["_hash", "_lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, values = [], []
            for text in batch.column(1).to_pylist():
                v = features(text or "")
                at = np.flatnonzero(v)
                places.append(at.astype("<u2").tobytes())
                values.append(v[at].tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (0, 2, 3)), pa.array(places, pa.binary()), pa.array(values, pa.binary())], names=["_lang", "_hash", "_most", "at", "v"])

    drawn = texts.select("_lang", "_text", "_hash", "_most").mapInArrow(run, "_lang string, _hash long, _most int, at binary, v binary").collect()
    if not drawn:
        return None
    drawn.sort(key=lambda r: (r[0], r[1] % (1 << 64)))  # any order of the rows gives the same model
    used, rows = Counter(), []
    for lang, _, most_of, at, v in drawn:
        used[lang] += 1
        if used[lang] <= most_of:
            rows.append((lang, at, v))
    x = np.zeros((len(rows), DIMS), dtype=np.float32)
    for i, (_, at, v) in enumerate(rows):
        x[i, np.frombuffer(at, "<u2")] = np.frombuffer(v, np.float32)
    languages = np.asarray([r[0] for r in rows])
    families = np.asarray([FAMILY_OF.get(code.lower(), code) for code in languages])
    within = {f: fit_machine(x[families == f], languages[families == f]) for f in sorted(set(families))}
    return Model(fit_machine(x, families), within)


def _predicted(texts: pa.Array, model: Model | None) -> list[tuple[str, float]]:
    """The language and score of each text."""
    import regex

    letter = regex.compile(r"\p{L}").search
    return [model.predict(t) if model and t and letter(t) else ("und", 0.0) for t in (x.as_py() for x in texts)]


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` of every whole text; ``und`` and 0 if it is null or has no letter or there is no model.

    Only the text is looked at. An empty table gives no rows; repeated ids give a row each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _predicted(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that are in no language, each judged by its own text whatever its id; all columns stay.

    Rows go through the model as they are: nothing is shuffled.
    """
    model = fit(docs, id_col, text_col, lang_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [language != "und" for language, _ in _predicted(batch.column(1), model)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(kept, pa.bool_()))], names=["_row"])

    found = rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}")
    return found.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
