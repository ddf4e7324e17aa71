"""Text functions: normal form, tokens, negation, values in text, and string similarities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Contractions, with and without the apostrophe, and what they stand for.
CONTRACTIONS = (
    ("don't", "do not"), ("dont", "do not"), ("doesn't", "does not"), ("doesnt", "does not"), ("didn't", "did not"), ("didnt", "did not"), ("can't", "cannot"), ("cant", "cannot"),
    ("couldn't", "could not"), ("couldnt", "could not"), ("isn't", "is not"), ("isnt", "is not"), ("aren't", "are not"), ("arent", "are not"), ("wasn't", "was not"), ("wasnt", "was not"),
    ("weren't", "were not"), ("werent", "were not"), ("haven't", "have not"), ("havent", "have not"), ("hasn't", "has not"), ("hasnt", "has not"), ("hadn't", "had not"), ("hadnt", "had not"),
    ("won't", "will not"), ("wont", "will not"), ("wouldn't", "would not"), ("wouldnt", "would not"),
    ("i'm", "i am"), ("im", "i am"), ("i've", "i have"), ("ive", "i have"), ("i'll", "i will"), ("i'd", "i would"),
)
#: Words that negate what follows, words that negate what precedes, and words that end a clause.
CUES_BEFORE = ("no", "not", "never", "without", "neither", "nor", "deny", "denies", "denied", "absent", "lack", "lacks", "lacking", "negative", "ruled")
CUES_AFTER = ("not", "absent", "negative")
CLAUSE_ENDS = ("but", "however", "although", "though", "except", "instead", "yet")
#: Words that carry no content.
STOP = ("a", "an", "the", "of", "any", "i", "have", "has", "is", "was", "there", "to", "and", "do")


def raw_words(text: Column) -> Column:
    """Words as ``normalised`` takes them, contractions and apostrophes left; the normal form of a text is that of its words in a row."""
    return F.split(F.regexp_replace(F.replace(F.lower(text), F.lit("’"), F.lit("'")), r"[^a-z0-9.']+|\.(?![0-9])", " "), " +")


def normalised(text: Column) -> Column:
    """Lower case, contracted words written out, all but letters, digits and inner decimal points blanked, blanks squeezed."""
    long = F.create_map(*[F.lit(x) for pair in CONTRACTIONS for x in pair])
    written = F.transform(raw_words(text), lambda w: F.coalesce(F.try_element_at(long, w), w))
    return F.trim(F.regexp_replace(F.array_join(written, " "), r"[ ']+", " "))


def tokens(normal: Column) -> Column:
    """Words of a normalised text; none for an empty one."""
    return F.filter(F.split(normal, " "), lambda w: w != "")


def content_tokens(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*STOP) & (F.length(w) > 1))


def overlap(a: Column, b: Column) -> Column:
    """Shared share of the smaller of two sets of words."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def negated(words: Column, first: Column, count: Column, before: int = 6, after: int = 4) -> Column:
    """Whether the ``count`` words from number ``first`` (from 1) on are negated.

    A cue among the ``before`` words ahead of them negates unless a clause ends between; so does one among the ``after``
    words behind them up to a clause's end, and ``ruled out`` among all of these.
    """
    start = F.greatest(F.lit(1), first - before)
    ahead = F.slice(words, start, first - start)
    behind = F.slice(words, first + count, after)
    early = _last_position(ahead, CUES_BEFORE) > _last_position(ahead, CLAUSE_ENDS)
    late = _first_position(behind, CUES_AFTER) < _first_position(behind, CLAUSE_ENDS)
    ruled = F.concat(F.lit(" "), F.concat_ws(" ", behind), F.lit(" ")).contains(" ruled out ")
    return early | late | ruled


def _last_position(words: Column, some: tuple[str, ...]) -> Column:
    """Place from 1 of the last of ``some`` words; 0 for none."""
    return F.coalesce(F.array_max(F.transform(words, lambda w, i: F.when(w.isin(*some), i + 1).otherwise(0))), F.lit(0))


def _first_position(words: Column, some: tuple[str, ...]) -> Column:
    """Place from 1 of the first of ``some`` words; 99 for none."""
    return F.coalesce(F.array_min(F.transform(words, lambda w, i: F.when(w.isin(*some), i + 1).otherwise(99))), F.lit(99))


#: Words that speak of pain, and phrases that give a value of it from 0 to 10.
PAIN = ("pain", "ache", "aching", "hurt", "hurts", "painful")
PAIN_VALUES = {
    "intensity": (r"\bpain\s+intensity\s+(?:is|at|of)\s+(10|[0-9])\b", r"\bintensity\s+of\s+the\s+pain\s+(?:is|at|of)\s+(10|[0-9])\b", r"\bpain\s+level\s+(?:is|at|of)\s+(10|[0-9])\b", r"\bpain\s+is\s+(10|[0-9])\s*(?:/10|out\s+of\s+10)\b"),
    "onset": (r"\bpain\s+onset\s+(?:is|at|of)\s+(10|[0-9])\b", r"\bpain\s+appeared\s+(?:at|with)\s+(10|[0-9])\b", r"\bpain\s+started\s+(?:at|with)\s+(10|[0-9])\b"),
    "precision": (r"\bpain\s+locali[sz]ation\s+(?:is|at|of)\s+(10|[0-9])\b", r"\bpain\s+location\s+(?:is|at|of)\s+(10|[0-9])\b", r"\blocali[sz]ation\s+precision\s+(?:is|at|of)\s+(10|[0-9])\b"),
}


def pain_value(text: Column, which: str) -> Column:
    """The value from 0 to 10 that a text gives for its pain's intensity, onset or precision of place; null for none."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.replace(F.lower(text), F.lit("’"), F.lit("'")), F.lit("-"), F.lit(" ")), r"[^a-z0-9\s']", " "), r"\s+", " "))
    found = F.coalesce(*[F.nullif(F.regexp_extract(plain, p, 1), F.lit("")) for p in PAIN_VALUES[which]])
    return F.when(plain.rlike(r"\b(" + "|".join(PAIN) + r")\b"), found.cast("int"))


def intensity(text: Column) -> Column:
    """A level from 0 to 10 given as ``n/10`` or ``n out of 10``; null where there is none."""
    raw = F.regexp_extract(F.lower(text), r"\b(10|[0-9])\s*(?:/|out of)\s*10\b", 1)
    return F.when(raw != "", raw.cast("int"))


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one row of bits: a bit of ``rows`` for each character of the longer text."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    masks = dict.fromkeys(a, 0)
    for i, y in enumerate(b):
        if y in masks:
            masks[y] |= 1 << i
    full = (1 << len(b)) - 1
    rows = full
    for x in a:
        met = rows & masks[x]
        rows = ((rows + met) | (rows - met)) & full
    return len(b) - rows.bit_count()


def indel(a: str, b: str) -> float:
    """One less the share of insertions and deletions: 2 * longest common subsequence / total length."""
    return 2.0 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``indel`` of pairs of short strings; nulls give null."""
    return pd.Series([None if x is None or y is None else indel(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def token_sort(a: str, b: str) -> float:
    """``indel`` of two texts with their words sorted."""
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial_bound(n, pairs):
    """At least the partial ratio of a text of ``n`` letters of which ``pairs`` adjacent ones are in the other text.

    Of stretches as long, and of shorter ones at either end, the one where the bounds by letters and by pairs meet.
    """
    return np.where(n < 4, 1.0, np.minimum(1.0, 2.0 * (n + pairs + 1) / np.maximum(3 * n + pairs + 1, 1)))


class Letters:
    """A text whose stretches many short ones are compared with: its letters and pairs of them as small numbers."""

    def __init__(self, text: str):
        self.text = text
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        distinct, self.of = np.unique(codes, return_inverse=True)
        self.letters = {chr(c): i for i, c in enumerate(distinct.tolist())}
        pairs, self.pair_of = np.unique(codes[:-1] << 32 | codes[1:], return_inverse=True) if len(codes) > 1 else (np.empty(0, np.int64), np.empty(0, np.int64))
        self.pairs = {chr(c >> 32) + chr(c & 0xFFFFFFFF): i for i, c in enumerate(pairs.tolist())}

    def partial_bound(self, short: str) -> float:
        """At least ``partial``, by the letters and the pairs of letters of ``short`` in each stretch."""
        n, size = len(short), len(self.text)
        if n < 4 or n > size:
            return 1.0
        at = np.arange(-(n - 1), size)  # where stretches begin
        low, high = np.maximum(at, 0), np.minimum(at + n, size)

        def counted(known: dict[str, int], of: np.ndarray, parts: set[str], last: np.ndarray) -> np.ndarray:
            held = np.zeros(len(known) + 1, dtype=np.int64)
            held[[known.get(x, -1) for x in parts]] = 1
            held[-1] = 0
            upto = np.append(0, np.cumsum(held[of]))
            return upto[np.maximum(last, low)] - upto[low]

        letters = counted(self.letters, self.of, set(short), high)
        pairs = counted(self.pairs, self.pair_of, {short[i : i + 2] for i in range(n - 1)}, high - 1)
        most = np.minimum(np.minimum(letters, high - low), (n + high - low + 1 + pairs) // 3)
        return float((2.0 * most / (n + high - low)).max())

    def partial(self, short: str) -> float:
        """The best ``indel`` of the shorter text with a stretch of the longer one of its length, or a shorter one at either end.

        All stretches are compared at once, each by the bits of one word, or one after the other where 63 bits do not do.
        """
        long, n = self.text, len(short)
        if n > len(long):
            return Letters(short).partial(long)
        if not n:
            return float(not long)
        if n > 63:
            whole = (long[i : i + n] for i in range(len(long) - n + 1))
            ends = (x for k in range(1, n) for x in (long[:k], long[-k:]))
            return max(indel(short, x) for x in (*whole, *ends))
        masks = np.zeros(len(self.letters) + 1, dtype=np.uint64)
        for i, x in enumerate(short):
            masks[self.letters.get(x, -1)] |= np.uint64(1 << i)
        padded = np.zeros(len(long) + 2 * (n - 1), dtype=np.uint64)  # no character stands at either end
        padded[n - 1 : n - 1 + len(long)] = masks[self.of]
        count = len(padded) - n + 1
        full = np.uint64((1 << n) - 1)
        rows = np.full(count, full)
        for i in range(n):
            met = rows & padded[i : i + count]
            rows = ((rows + met) | (rows - met)) & full
        begins = np.arange(count) - (n - 1)
        length = np.minimum(begins + n, len(long)) - np.maximum(begins, 0)
        return float((2.0 * (n - np.bitwise_count(rows).astype(np.int64)) / (n + length)).max())


def partial(a: str, b: str) -> float:
    """The best ``indel`` of the shorter of two texts with a stretch of the longer one: see ``Letters.partial``."""
    return Letters(b).partial(a)


def token_set(a: str, b: str) -> float:
    """The best ``indel`` of the words that two texts share and of these with what is left of either."""
    return set_ratio(set(a.split()), set(b.split()))


def set_ratio(x: set[str], y: set[str]) -> float:
    """``token_set`` of sets of words. What is shared begins both longer texts, so only these need to be compared."""
    if not x or not y:
        return 0.0
    both, one, other = x & y, x - y, y - x
    if both and (not one or not other):
        return 1.0
    if not both:
        return indel(" ".join(sorted(one)), " ".join(sorted(other)))
    shared = " ".join(sorted(both))
    first, second = (f"{shared} {' '.join(sorted(s))}" for s in (one, other))
    begins = max(2.0 * len(shared) / (len(shared) + len(s)) for s in (first, second))
    return begins if begins >= 2.0 * min(len(first), len(second)) / (len(first) + len(second)) else max(begins, indel(first, second))


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``token_sort`` of pairs of short strings; nulls give null."""
    return pd.Series([None if x is None or y is None else token_sort(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


#: Letters with a sound class and the classes of them.
_LETTERS, _CLASSES = "bfpvcgjkqsxzdtlmnr", "111122222222334556"


def sounds(word: Column) -> Column:
    """A letter and three digits; every other letter, vowels and h, w alike, ends a run, and the first letter's class is not counted."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    coded = F.regexp_replace(F.translate(F.substring(letters, 2, 1_000), _LETTERS, _CLASSES), "[a-z]", "0")
    digits = F.replace(F.regexp_replace(coded, r"([1-6])\1+", "$1"), F.lit("0"), F.lit(""))
    return F.when(letters == "", "").otherwise(F.rpad(F.concat(F.upper(F.left(letters, F.lit(1))), digits), 4, "0"))
