"""Free text to codes: exact and contained aliases, token overlap, fuzzy and phonetic matches, and whether they are negated."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import Letters, content_tokens, indel, negated, normalised, partial_bound, raw_words, set_ratio, sounds, token_sort_ratio, tokens
from tidemark.session import stored

#: Words before and behind a match that decide on its negation; words that a window may have above an alias's.
BEFORE, AFTER, EXTRA = 6, 4, 4
#: Aliases that are broadcast to where texts are; more of them are joined by a shuffle of words with their surroundings.
FEW = 200_000
#: Words of grammar, and others that say as little; these weigh a sixth of other words in a window.
GRAMMAR = (
    "i", "me", "my", "mine", "we", "our", "ours", "you", "your", "yours", "he", "him", "his", "she", "her", "hers", "they", "them", "their", "theirs", "the", "a", "an", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "will", "would", "should", "could", "can", "may", "might",
    "feel", "feeling", "felt", "seem", "seems", "seemed", "very", "really", "quite", "just", "some", "any", "something", "someone", "today", "yesterday", "tomorrow", "currently", "recently",
    "for", "since", "during", "from", "with", "without", "and", "or", "but", "so", "to", "of", "in", "on", "at", "by", "as", "about", "into", "when", "while", "where", "why", "how", "than", "then",
)
#: Stretches of a text that are compared with all names at once.
STRETCHES = 4096
#: Pairs of words that are compared at once; windows of texts that are, and words of the texts that these are taken from.
PAIRS, ROWS, SOME = 1 << 16, 4096, 100_000
#: Texts whose near words meet in one task, where there are too many of these to broadcast.
TEXTS = 1000
#: Share of an alias's words that a span has at least, unless it holds the whole phrase.
ENOUGH = 0.67
LITTLE = (*GRAMMAR, "bad", "good", "little", "much", "more", "less")


def prepared(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, normal, words`` of each text; null texts have no words."""
    normal = texts.select(F.col(id_col).alias("id"), normalised(F.coalesce(F.col(text_col), F.lit(""))).alias("normal"))
    return normal.select("id", "normal", tokens(F.col("normal")).alias("words"))


def distinct_words(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``word``: the words of the normal forms of all texts; contractions are written out of distinct words, not of each one said."""
    # the outer form: with the other one the optimiser asks for texts with words first, and finds the words of each once more for that
    said = texts.select(F.explode_outer(raw_words(F.coalesce(F.col(text_col), F.lit("")))).alias("raw")).distinct()
    return said.select(F.explode_outer(tokens(normalised(F.col("raw")))).alias("word")).where("word is not null").distinct()


def alias_words(aliases: DataFrame) -> DataFrame:
    """``alias, code, alias_tokens, n_alias, head``: aliases in normal form, the word that they are looked up by first."""
    words = tokens(normalised(F.col("alias")))
    return aliases.select(normalised(F.col("alias")).alias("alias"), "code", words.alias("alias_tokens"), F.size(words).alias("n_alias"), F.element_at(words, 1).alias("head")).where("n_alias > 0")


def exact(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """``id, code`` where the whole normal text is an alias: an equi-join."""
    return prepared(texts).join(alias_words(aliases).select("alias", "code"), F.col("normal") == F.col("alias")).select("id", "code").distinct()


def _met(texts: DataFrame, heads: DataFrame, before: int, behind: int, few: bool) -> DataFrame:
    """Words of ``prepared`` texts that are in ``heads`` (column ``head``): ``id, pos, first, near`` and the columns of ``heads``.

    ``pos`` is a word's place from 0 on, ``near`` up to ``before`` words before it, itself (number ``first``) and ``behind``
    behind it. A few heads are sent to the texts, and only around words that are found is anything cut out; else each word
    goes to its head with its surroundings, not with its text.
    """
    ahead = F.least(F.col("pos"), F.lit(before))
    near = {"first": ahead + 1, "near": F.slice("words", F.col("pos") - ahead + 1, ahead + 1 + behind)}
    # the outer form: with the other one the optimiser asks for texts with words first, and finds the words of each once more for that
    words = texts.select("id", "words", F.posexplode_outer("words").alias("pos", "head")).where("head is not null")
    met = words.join(F.broadcast(heads), "head").withColumns(near) if few else words.withColumns(near).drop("words").join(heads, "head")
    return met.drop("words")


def contained(texts: DataFrame, aliases: DataFrame, few: int = FEW) -> DataFrame:
    """``id, code, place, n_alias, negated``: aliases that occur word for word, at each place.

    Texts are blocked by word: each word is looked up as the head of an alias, so no text meets all aliases; up to ``few``
    aliases are sent to the texts (see ``_met``).
    """
    names = alias_words(aliases)
    most, count = names.agg(F.coalesce(F.max("n_alias"), F.lit(0)), F.count("*")).first()
    met = _met(prepared(texts), names, BEFORE, most + AFTER, count <= few)
    hit = met.where(F.slice("near", F.col("first"), F.col("n_alias")) == F.col("alias_tokens"))
    return hit.select("id", "code", (F.col("pos") + 1).alias("place"), "n_alias", F.coalesce(negated(F.col("near"), F.col("first"), F.col("n_alias"), BEFORE, AFTER), F.lit(False)).alias("negated"))


def contained_in_wordings(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """``contained`` for texts that repeat, such as reports in fixed wordings: each wording is looked up once.

    What a text is matched with depends on nothing else. Matches of the distinct wordings are written and go to where the
    texts are, as long as they are few; else texts and matches meet by a shuffle.
    """
    found = stored(contained(texts.groupBy("text").agg(F.first("text").alias("id")), aliases).withColumnRenamed("id", "text"))
    met = F.broadcast(found) if found.count() <= FEW else found
    return texts.select("id", "text").join(met, "text").drop("text")


def longest(found: DataFrame) -> DataFrame:
    """Of matches that lie within a longer one of the same text, only the longer one. Matches of a text are few."""
    a, b = found.alias("a"), found.alias("b")
    inside = (F.col("a.id") == F.col("b.id")) & (F.col("b.place") <= F.col("a.place")) & (F.col("b.place") + F.col("b.n_alias") >= F.col("a.place") + F.col("a.n_alias")) & (F.col("b.n_alias") > F.col("a.n_alias"))
    return a.join(b, inside, "left_anti")


def by_overlap(texts: DataFrame, aliases: DataFrame, least: float = 0.5) -> DataFrame:
    """``id, code, shared, coverage, precision, score``: aliases that share content words with a text.

    Both sides are reduced to (id, word) pairs that are distinct, joined on the word and counted.
    """
    mine = prepared(texts).select("id", F.array_distinct(content_tokens(F.col("words"))).alias("w"))
    mine = mine.select("id", F.size("w").alias("n_text"), F.explode_outer("w").alias("word")).where("word is not null")
    theirs = alias_words(aliases).select("code", F.array_distinct("alias_tokens").alias("w"))
    theirs = theirs.select("code", F.size("w").alias("n_alias"), F.explode("w").alias("word"))
    met = mine.join(theirs, "word").groupBy("id", "code").agg(F.count("*").alias("shared"), F.first("n_text").alias("n_text"), F.first("n_alias").alias("n_alias"))
    coverage, precision = F.col("shared") / F.col("n_alias"), F.col("shared") / F.col("n_text")
    score = 0.6 * coverage + 0.4 * precision
    return met.where(coverage >= least).select("id", "code", "shared", F.round(coverage, 6).alias("coverage"), F.round(precision, 6).alias("precision"), F.round(score, 6).alias("score"))


@functools.lru_cache(maxsize=4096)
def _plan(m: int, least: float, lengths: frozenset[int] | None = None) -> list[tuple[int, list[int], int, int]]:
    """For each length ``n`` that a word near one of ``m`` letters may have: ``n``, where it is cut, and how far pieces may move.

    Of words of ``m`` and ``n`` letters at an Indel ratio of ``least`` at most ``most`` letters are added or taken away. Each of
    these touches one piece of a word at most, so of one piece more than that one stays whole; letters taken from the one
    move it back, letters of the other move it on.
    """
    out = []
    for n in range(max(1, math.ceil(m * least / (2 - least) - 1e-9)), math.floor(m * (2 - least) / least + 1e-9) + 1):
        most = m + n - 2 * math.ceil(least * (m + n) / 2 - 1e-9)
        if most >= 0 and (lengths is None or n in lengths):
            out.append((n, [i * n // (most + 1) for i in range(most + 2)], (most + n - m) // 2, (most + m - n) // 2))
    return out


def _pieces(word: str, least: float, _: frozenset[int] | None) -> list[str]:
    """Keys of a word: its pieces, by both lengths and their number, for each length that a near word may have."""
    n, out = len(word), []
    for m, *_ in _plan(n, least):
        cuts = next(c for k, c, _, _ in _plan(m, least) if k == n)
        out += [f"{m}|{n}|{i}|{word[a:b]}" for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return out


def _stretches(word: str, least: float, lengths: frozenset[int] | None) -> list[str]:
    """Keys of a word: its stretches where a piece of a near word may be, for each of ``lengths`` that such a word may have."""
    m, out = len(word), []
    for n, cuts, back, on in _plan(m, least, lengths):
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out += [f"{m}|{n}|{i}|{word[at : at + b - a]}" for at in range(max(0, a - back), min(a + on, m - b + a) + 1)]
    return out


def _all_keys(word: str, stem: str, sound: str, parts, least: float, lengths: frozenset[int] | None = None) -> set[str]:
    """Keys of a word as it is and of its lemma; sound codes and pieces only from four letters on."""
    keys = {f"w{word}", f"w{stem}"}
    if len(word) >= 4:
        keys.update((f"s{word[0]}{sound}",), parts(word, least, lengths), parts(stem, least, lengths) if stem != word else ())
    return keys


def _keys_of(parts, least: float, lengths: frozenset[int] | None = None) -> Column:
    @F.pandas_udf("array<string>")
    def keys(word: pd.Series, stem: pd.Series, sound: pd.Series) -> pd.Series:
        return pd.Series([sorted(_all_keys(*x, parts, least, lengths)) for x in zip(word, stem, sound, strict=True)], dtype=object)

    return keys("word", "lemma", "sound")


def _index(words: list[tuple[str, str, str]], least: float) -> dict[tuple, dict[str, list[str]]]:
    """Alias words by whole words and lemmas, by sound codes, and by each of their pieces."""
    out: dict[tuple, dict[str, list[str]]] = {}
    for word, stem, sound in words:
        for key in _all_keys(word, stem, sound, _pieces, least):
            *where, part = key.split("|", 3) if "|" in key else (key[0], key[1:])
            out.setdefault(tuple(where), {}).setdefault(part, []).append(word)
    return out


def _found(word: str, stem: str, sound: str, index: dict, least: float, lengths: frozenset[int]) -> list[str]:
    """The alias words that share a key with a word."""
    out = [*index.get(("w",), {}).get(word, ()), *index.get(("w",), {}).get(stem, ())]
    if len(word) >= 4:
        out += index.get(("s",), {}).get(word[0] + sound, ())
        for x in {word, stem}:
            m = len(x)
            for n, cuts, back, on in _plan(m, least, lengths):
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if pieces := index.get((str(m), str(n), str(i))):
                        for at in range(max(0, a - back), min(a + on, m - b + a) + 1):
                            if hit := pieces.get(x[at : at + b - a]):
                                out += hit
    return sorted(set(out))


def nearness(one: tuple[str, str, str], other: tuple[str, str, str], least: float) -> tuple[str, float] | None:
    """Tier and similarity of two words, each given with its lemma and sound code; None if they are not near."""
    (a, stem, sound), (b, _stem, _sound) = one, other
    if a == b:
        return "exact", 1.0
    if stem in (_stem, b) or a == _stem:
        return "lemma", 0.98
    if min(len(a), len(b)) < 4:
        return None
    ratio = indel(a, b)
    best = max(ratio, *(indel(x, y) for x, y in ((a, _stem), (stem, b), (stem, _stem)) if (x, y) != (a, b)), 0.0)
    if best >= least:
        return "edited", round(best, 6)
    return ("phonetic", 0.82) if sound == _sound and a[0] == b[0] and ratio >= 0.45 else None


class NearWords:
    """Words held against the few alias words that share a key with each: ``nearness`` for many pairs at once.

    A row of bits for each pair, as in ``common``, so alias words of up to 63 letters; pairs with a longer one are compared
    one by one. ``words`` are alias words with their lemmas and sound codes.
    """

    def __init__(self, words: list[tuple[str, str, str]], least: float):
        self.least, self.index, self.known = least, _index(words, least), {r[0]: r for r in words}
        forms = list(dict.fromkeys(x for r in words for x in r[:2]))
        self.form = {x: i for i, x in enumerate(forms)}
        self.length = np.asarray([len(x) for x in forms], dtype=np.int64)
        short = [x if len(x) <= 63 else "" for x in forms]
        letters = sorted(set().union(*short))
        self.letter = np.zeros(max(map(ord, letters), default=0) + 2, dtype=np.int32)  # 0 of any other letter
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.masks = np.zeros((len(forms), len(letters) + 1), dtype=np.uint64)
        for i, x in enumerate(short):
            for j, c in enumerate(x):
                self.masks[i, self.letter[ord(c)]] |= np.uint64(1 << j)

    def ratios(self, texts: list[str], of: np.ndarray, form: np.ndarray) -> np.ndarray:
        """``indel`` of ``texts[of]`` and the alias words' forms of numbers ``form``."""
        size = np.asarray([len(x) for x in texts], dtype=np.int64)
        out = np.zeros(len(of))
        order = np.argsort(size[of], kind="stable")
        for low in range(0, len(of), PAIRS):
            at = order[low : low + PAIRS]
            u, v = of[at], form[at]
            width = int(size[u].max())
            distinct, row = np.unique(u, return_inverse=True)
            codes = np.frombuffer("".join(texts[i].ljust(width, "\0") for i in distinct).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(distinct), width)
            numbers = self.letter[np.minimum(codes, len(self.letter) - 1)]
            full = (np.uint64(1) << self.length[v].clip(max=63).astype(np.uint64)) - np.uint64(1)
            rows = full.copy()
            for i in range(width):
                met = rows & self.masks[v, numbers[row, i]]
                rows = ((rows + met) | (rows - met)) & full
            shared = self.length[v] - np.bitwise_count(rows).astype(np.int64)
            out[at] = 2.0 * shared / np.maximum(self.length[v] + size[u], 1)
            for k in np.flatnonzero(self.length[v] > 63):
                out[at[k]] = indel(texts[u[k]], next(x for x, i in self.form.items() if i == v[k]))
        return out

    def near(self, words: list[tuple[str, str, str]], lengths: frozenset[int]) -> list[list[dict]]:
        """For each word the alias words near it, as ``nearness`` has them."""
        out: list[list[dict]] = [[] for _ in words]
        of, names = [], []
        for i, (a, stem, sound) in enumerate(words):
            for b in _found(a, stem, sound, self.index, self.least, lengths):
                _, _stem, _ = self.known[b]
                if a == b or stem in (_stem, b) or a == _stem:
                    out[i].append({"alias_word": b, "tier": "exact" if a == b else "lemma", "similarity": 1.0 if a == b else 0.98})
                elif min(len(a), len(b)) >= 4:
                    of.append(i)
                    names.append(b)
        if not of:
            return out
        row = np.asarray(of)
        own, stems = np.asarray([self.form[b] for b in names]), np.asarray([self.form[self.known[b][1]] for b in names])
        said, said_stem = [w[0] for w in words], [w[1] for w in words]
        ratio = self.ratios(said, row, own)
        best = ratio.copy()
        other, bare = stems != own, np.asarray([x != y for x, y in zip(said, said_stem, strict=True)])[row]
        for texts, which, form in ((said, other, stems), (said_stem, bare, own), (said_stem, other | bare, stems)):
            if which.any():
                best[which] = np.maximum(best[which], self.ratios(texts, row[which], form[which]))
        for k in np.flatnonzero((best >= self.least) | (ratio >= 0.45)).tolist():
            i, b = of[k], names[k]
            if best[k] >= self.least:
                out[i].append({"alias_word": b, "tier": "edited", "similarity": round(float(best[k]), 6)})
            elif words[i][2] == self.known[b][2] and words[i][0][0] == b[0]:
                out[i].append({"alias_word": b, "tier": "phonetic", "similarity": 0.82})
        return out


def _near_by_keys(shared, lengths: frozenset[int]) -> Column:
    @F.pandas_udf("array<struct<alias_word:string,tier:string,similarity:double>>")
    def near(word: pd.Series, stem: pd.Series, sound: pd.Series) -> pd.Series:
        return pd.Series(shared.value.near(list(zip(word, stem, sound, strict=True)), lengths), dtype=object)

    return near("word", "lemma", "sound")


def _near_pairs(least: float) -> Column:
    @F.pandas_udf("tier string, similarity double")
    def near(*columns: pd.Series) -> pd.DataFrame:
        said = [nearness(x[:3], x[3:], least) or (None, None) for x in zip(*columns, strict=True)]
        return pd.DataFrame(said, columns=["tier", "similarity"])

    return near("word", "lemma", "sound", "alias_word", "_lemma", "_sound")


def fuzzy(words: DataFrame, aliases: DataFrame, least: float = 0.78, few: int = FEW // 10) -> DataFrame:
    """``word, alias_word, tier, similarity`` for the distinct words of ``words`` (column ``word``).

    Tiers: exact (1.0), lemma (0.98), edited (the best Indel ratio of both words and their lemmas, ``least`` or more, for
    words of four letters or more) and phonetic (0.82, for words of one sound code and first letter whose ratio is 0.45 or
    more). No pair is lost: pairs come from equal words or lemmas, sound codes, and the pieces of which a near word must
    hold one (``_pieces``); only these are compared. The keys of up to ``few`` alias words are sent to the words as an
    index, more of them are joined.
    """
    named = lambda frame: frame.where(F.length("word") >= 1).select("word", lemma(F.col("word")).alias("lemma"), sounds(F.col("word")).alias("sound"))
    theirs = named(alias_words(aliases).select(F.explode("alias_tokens").alias("word")).distinct())
    lengths = frozenset(r[0] for r in theirs.select(F.explode(F.array(F.length("word"), F.length("lemma")))).distinct().collect())  # no more than the longest word has letters
    spark = words.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work
    mine = named(words.select("word").distinct().repartition(tasks, F.xxhash64("word")))  # by the word itself nothing would be dealt, as it is grouped by that
    held = theirs.limit(few + 1).collect()
    if len(held) <= few:
        shared = spark.sparkContext.broadcast(NearWords([tuple(r) for r in held], least))
        return mine.select("word", F.inline(_near_by_keys(shared, lengths)))
    right = theirs.select(F.col("word").alias("alias_word"), F.col("lemma").alias("_lemma"), F.col("sound").alias("_sound"), F.explode(_keys_of(_pieces, least)).alias("key"))
    pairs = mine.select("word", "lemma", "sound", F.explode(_keys_of(_stretches, least, lengths)).alias("key")).join(right, "key").drop("key").distinct()
    return pairs.select("word", "alias_word", _near_pairs(least).alias("n")).select("word", "alias_word", "n.*").where("tier is not null")


def lemma(word: Column) -> Column:
    """A word without the ending of a plural, a participle or a past, where four letters or more are left."""
    return F.regexp_replace(word, r"^(.{4,}?)(?:ings?|ed|es|s)$", "$1")


def best_windows(similar: np.ndarray, sound: np.ndarray, weight: np.ndarray, n_alias: int) -> tuple[np.ndarray, ...]:
    """Of each row the window over its middle word that fits an alias of ``n_alias`` words best.

    ``similar`` and ``sound`` are rows x words x words of the alias: how near they are, and whether by sound alone;
    ``weight`` is that of each word, 0 beyond a text's ends. All rows are tried with one window after the other, shorter
    and earlier ones first. In a window each word of the alias takes the nearest word left, the first of equally near
    ones. Returns ``local, start, size, coverage, precision, mean, worst, by_sound, taken``; ``local`` is -1 where no word
    is near, and ``taken`` marks the words that were taken.
    """
    rows, width, _ = similar.shape
    middle, most = width // 2, n_alias + EXTRA
    best = {"local": np.full(rows, -1.0), "start": np.zeros(rows, int), "size": np.zeros(rows, int), "coverage": np.zeros(rows), "precision": np.zeros(rows), "mean": np.zeros(rows), "worst": np.zeros(rows), "by_sound": np.zeros(rows, bool), "taken": np.zeros((rows, width), bool)}
    every = np.arange(rows)
    for size in range(1, most + 1):
        for start in range(max(0, middle - size + 1), min(middle, width - size) + 1):
            window = slice(start, start + size)
            inside = (weight[:, window] > 0).all(axis=1)
            taken = np.zeros((rows, size), dtype=bool)
            got, total, least, heard = np.zeros(rows, int), np.zeros(rows), np.full(rows, np.inf), np.zeros(rows, bool)
            for t in range(n_alias):
                near = np.where(taken, 0.0, similar[:, window, t])
                place = near.argmax(axis=1)
                score = near[every, place]
                hit = score > 0
                taken[every[hit], place[hit]] = True
                got += hit
                total = np.where(hit, total + score, total)
                least = np.where(hit, np.minimum(least, score), least)
                heard |= hit & sound[every, start + place, t]
            coverage, mean = got / n_alias, total / np.maximum(got, 1)
            precision = np.where(taken, weight[:, window], 0.0).sum(axis=1) / np.maximum(weight[:, window].sum(axis=1), 1e-12)
            local = 0.50 * coverage + 0.30 * mean + 0.20 * precision - 0.035 * max(0, size - n_alias) + np.where(got == n_alias, 0.08, 0.0)
            better = inside & (got > 0) & (np.round(local, 9) > np.round(best["local"], 9))
            values = {"local": local, "start": start, "size": size, "coverage": coverage, "precision": precision, "mean": mean, "worst": least, "by_sound": heard}
            for name, value in values.items():
                best[name] = np.where(better, value, best[name])
            best["taken"][better] = False
            best["taken"][better, start : start + size] = taken[better]
    return best


def _spread(places: int, reach: int) -> int:
    """The bits of ``places`` and those up to ``reach`` before and behind them."""
    done, step = 0, 1
    up = places
    while done < 2 * reach:
        step = min(step, 2 * reach - done)
        up |= up << step
        done += step
        step = done + 1
    return up >> reach


def _bits(number: int) -> list[int]:
    """Places of the bits of a number, in order."""
    held = np.frombuffer(number.to_bytes(number.bit_length() // 8 + 1, "little"), dtype=np.uint8)
    return np.flatnonzero(np.unpackbits(held, bitorder="little")).tolist()


def said_near(words: list[str], near: dict[str, list], aliases: list[tuple[str, list[str], list[str]]]) -> list[tuple[str, list[int]]]:
    """Which aliases a text may have a span of, with the places to try in order: ``places_to_try`` of one text, ``near`` by word."""
    rows = pd.DataFrame([(w, *x) for w, some in near.items() for x in some], columns=["word", "alias_word", "similarity", "by_sound"])
    at = TextSpans(rows, aliases).near(words)
    return [(aliases[number][0], [i for _, group in groups for i in group]) for number, groups in places_to_try(at, words, aliases)]


def places_to_try(at: dict[str, tuple[np.ndarray, ...]], words: list[str], aliases: list[tuple[str, list[str], list[str]]]) -> list[tuple[int, list[tuple[float, list[int]]]]]:
    """Which ``aliases`` (alias, its words, those that it is looked up by) a text may have a span of: by number, with the places to try.

    ``at`` has the places in ``words`` near each word of an alias, and how near they are. A span has ``ENOUGH`` of the
    alias's words, or its letters, around a word that it is looked up by; of an alias without such a place none is accepted.
    Places come in groups by how many of the alias's words are around, the most first, each with what a window there scores
    at most. A place with only one around has no better window than itself, so of these the first with the highest
    similarity stands for all. A word's places are the bits of a number, so a word of an alias costs a few operations for
    all places of a text.
    """
    bits, wide, joined, out = {}, {}, " ".join(words), []

    def bits_of(x: str) -> int:
        if x not in bits:
            held = np.zeros(len(words), dtype=bool)
            held[at[x][0]] = True
            bits[x] = int.from_bytes(np.packbits(held, bitorder="little").tobytes(), "little")
        return bits[x]

    for number, (alias, parts, heads) in enumerate(aliases):
        said, n = [x for x in parts if x in at], len(parts)
        reach, enough = n + EXTRA - 1, math.ceil(ENOUGH * n)
        if len(said) < enough and alias not in joined:
            continue
        places = 0
        for x in heads:
            if x in at:
                places |= bits_of(x)
        some = [places] + [0] * n  # places with so many words of the alias around
        for x in said if places and len(said) >= enough else ():
            if (x, n) not in wide:
                wide[x, n] = _spread(bits_of(x), reach)
            for k in range(n, 0, -1):
                some[k] |= some[k - 1] & wide[x, n]
        if not some[enough]:
            if not places or alias not in joined or not any(alias in " ".join(words[max(0, i - reach) : i + reach + 1]) for i in _bits(places)):
                continue
            some = [places] * (n + 1)
        groups = [(0.50 * k / n + 0.50 + (0.08 if k == n else 0.0), _bits(some[k] & ~(some[k + 1] if k < n else 0))) for k in range(n, 0, -1)]
        if n > 1 and groups[-1][1]:
            alone = np.zeros(len(words), dtype=bool)
            alone[groups[-1][1]] = True
            nearest = [(float(values[k].max()), -int(where[k][values[k].argmax()])) for x in heads if x in at for where, values, *_ in (at[x],) if (k := alone[where]).any()]
            groups[-1] = groups[-1][0], [-max(nearest)[1]]
        out.append((number, [(most, held) for most, held in groups if held]))
    return out


class TextSpans:
    """The best window of each alias in each text, for many texts at once.

    ``near`` has ``word, alias_word, similarity, by_sound``: which words are near one of an alias; ``aliases`` as ``places_to_try`` has them.
    """

    def __init__(self, near: pd.DataFrame, aliases: list[tuple[str, list[str], list[str]]]):
        self.aliases = aliases
        rows, words = pd.factorize(near["word"])
        order = np.argsort(rows, kind="stable")
        self.row = {w: i for i, w in enumerate(words)}
        self.starts = np.searchsorted(rows[order], np.arange(len(words) + 1))  # rows of a word lie side by side
        names, alias_words_of = pd.factorize(near["alias_word"])
        self.alias_words = list(alias_words_of)
        self.names, self.similar, self.by_sound = names[order], near["similarity"].to_numpy(dtype=float)[order], near["by_sound"].to_numpy(dtype=bool)[order]
        self.pad = max((len(a[1]) for a in aliases), default=0) + EXTRA - 1
        self.little = frozenset(LITTLE)

    def best(self, texts: list[list[str]]) -> list[tuple]:
        """``text, alias, local, place, size, coverage, precision, mean, worst, by_sound, matched``: a row for each text (its number) and alias (its number) that it may have a span of; places from 0 on.

        Places are tried group by group, and only while one may still have a better window than the best one so far.
        """
        sides, todo = [], []
        for t, words in enumerate(texts):
            at = self.near(words)
            may = places_to_try(at, words, self.aliases)
            needed = {x for number, _ in may for x in self.aliases[number][1]}
            sides.append({x: (places + self.pad, *values) for x, (places, *values) in at.items() if x in needed})
            todo += [(t, number, groups) for number, groups in may]
        best: dict[tuple[int, int], tuple] = {}
        for step in range(max((len(g) for *_, g in todo), default=0)):
            left = [(t, number, g[step][1]) for t, number, g in todo if step < len(g) and ((t, number) not in best or -best[t, number][0][0] <= g[step][0] + 1e-8)]
            for n in sorted({len(self.aliases[number][1]) for _, number, _ in left}):
                self._tried(texts, sides, [x for x in left if len(self.aliases[x[1]][1]) == n], n, best)
        return [(t, number, -key[0], key[2], key[1], *values) for (t, number), (key, *values) in best.items()]

    def near(self, words: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each word of an alias the places of ``words`` near it, how near they are, and whether by sound."""
        row = np.fromiter((self.row.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        places = np.flatnonzero(row >= 0)
        first, count = self.starts[row[places]], self.starts[row[places] + 1] - self.starts[row[places]]
        each = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        order = np.argsort(self.names[each], kind="stable")
        each, places = each[order], np.repeat(places, count)[order]
        ends = np.append(np.flatnonzero(np.diff(self.names[each], prepend=-1)), len(each)).tolist()
        return {self.alias_words[self.names[each[a]]]: (places[a:b], self.similar[each[a:b]], self.by_sound[each[a:b]]) for a, b in zip(ends, ends[1:], strict=False)}

    def _tried(self, texts, sides, left, n: int, best: dict) -> None:
        middle = n + EXTRA - 1
        rows, count, text = [], 0, None
        for t, number, places in left:
            if t != text:  # they come text by text
                text, words = t, texts[t]
                weight, similar, sound = (np.zeros(len(words) + 2 * self.pad, dtype=d) for d in (float, float, bool))
                weight[self.pad : self.pad + len(words)] = [0.10 if w in self.little else 0.60 for w in words]
            for low in range(0, len(places), ROWS):
                at = np.asarray(places[low : low + ROWS])
                around = at[:, None] + np.arange(self.pad - middle, self.pad + middle + 1)
                alike, heard = np.zeros((*around.shape, n)), np.zeros((*around.shape, n), dtype=bool)
                for k, x in enumerate(self.aliases[number][1]):
                    if x in sides[t]:
                        where, values, by_sound = sides[t][x]
                        similar[where], sound[where] = values, by_sound
                        alike[:, :, k], heard[:, :, k] = similar[around], sound[around]
                        similar[where], sound[where] = 0.0, False
                rows.append((np.full(len(at), t), np.full(len(at), number), at, alike, heard, weight[around]))
                count += len(at)
                if count >= ROWS:
                    self._scored(rows, n, best)
                    rows, count = [], 0
        if rows:
            self._scored(rows, n, best)

    def _scored(self, rows: list[tuple], n: int, best: dict) -> None:
        middle = n + EXTRA - 1
        t, number, at, similar, sound, weight = (np.concatenate(x) for x in zip(*rows, strict=True))
        found = best_windows(similar, sound, weight, n)
        local, start = np.round(found["local"], 9), at + found["start"] - middle
        order = np.lexsort((start, found["size"], -local, number, t))
        first = order[np.flatnonzero(np.diff(t[order], prepend=-1) | np.diff(number[order], prepend=-1))]
        for r in first.tolist():
            name, key = (int(t[r]), int(number[r])), (-float(local[r]), int(found["size"][r]), int(start[r]))
            if local[r] >= 0 and (name not in best or key < best[name][0]):
                values = [found[c][r].item() for c in ("coverage", "precision", "mean", "worst", "by_sound")]
                best[name] = key, *values, (np.flatnonzero(found["taken"][r]) + at[r] - middle).tolist()


def _around_by_shuffle(mine: DataFrame, heads: DataFrame, near: DataFrame, reach: int) -> DataFrame:
    """Found words of ``spans`` with their surroundings (``id, pos, alias, code, alias_tokens, around``), each word with the alias's words near it."""
    found = _met(mine, heads, reach, reach, False).select("id", "pos", "first", "alias", "code", "alias_tokens", "n_alias", F.posexplode("near").alias("i", "word"))
    found = found.withColumn("at", F.col("i") - F.col("first") + 1).where(F.abs("at") < F.col("n_alias") + EXTRA)  # places from the found word on
    by_word = near.groupBy("word").agg(F.collect_list(F.struct("alias_word", "similarity", "by_sound")).alias("like"))  # alias words near a word are few
    of = F.filter(F.coalesce("like", F.array().cast("array<struct<alias_word:string,similarity:double,by_sound:boolean>>")), lambda x: F.array_contains("alias_tokens", x["alias_word"]))
    of_alias = found.join(by_word, "word", "left").select("id", "pos", "alias", "code", "alias_tokens", F.struct("at", "word", of.alias("like")).alias("x"))
    around = of_alias.repartition("id", "alias", "code").groupBy("id", "pos", "alias", "code").agg(F.first("alias_tokens").alias("alias_tokens"), F.sort_array(F.collect_list("x")).alias("around"))
    # enough of an alias's words, or its letters, must be around some word, or no window of the text will do
    like = F.flatten(F.transform("around", lambda x: x["like"]["alias_word"]))
    share = F.size(F.filter("alias_tokens", lambda w: F.array_contains(like, w))) / F.size("alias_tokens")
    may = (share >= ENOUGH) | F.array_join(F.transform("around", lambda x: x["word"]), " ").contains(F.col("alias"))
    return around.withColumn("may", F.max(may).over(W.partitionBy("id", "alias", "code"))).where("may")


#: The best window of a text and alias, as ``spans`` judges it.
WINDOW = "local double, place int, size int, coverage double, precision double, mean double, worst double, by_sound boolean, window string, matched array<int>"


def _by_text(texts: pd.DataFrame, spans_of: TextSpans) -> Iterator[pd.DataFrame]:
    """Rows of ``id, alias`` and ``WINDOW`` for texts with ``id, normal``, so many of them at once as hold ``SOME`` words."""
    columns = ["id", "alias", *[c.split()[0] for c in WINDOW.split(", ")]]
    ids, words, count = [], [], 0
    for i, (key, normal) in enumerate(zip(texts["id"], texts["normal"], strict=True), 1):
        ids.append(key)
        words.append([w for w in normal.split(" ") if w])
        count += len(words[-1])
        if count >= SOME or i == len(texts):
            rows = []
            for t, number, local, place, size, *measures, taken in spans_of.best(words):
                window = " ".join(words[t][place : place + size])
                rows.append((ids[t], spans_of.aliases[number][0], local, place + 1, size, *measures, window, [x + 1 for x in taken]))
            yield pd.DataFrame(rows, columns=columns)
            ids, words, count = [], [], 0


def _best_at_texts(mine: DataFrame, names: DataFrame, near: DataFrame, looked_up: Column, few: int) -> DataFrame:
    """``id, code, alias`` and ``WINDOW``: the best window of each alias in each text, found where the texts are.

    Aliases are broadcast, and up to ``few`` near words. More of these are dealt to the texts that have them: texts make
    parts of about ``TEXTS``, and a part's own near words go to it, once each.
    """
    spark = mine.sparkSession
    aliases = [(r.alias, list(r.alias_tokens), list(dict.fromkeys(r.h))) for r in names.select("alias", "alias_tokens", looked_up.alias("h")).distinct().collect()]
    kind, mine = mine.schema["id"].dataType, mine.select(F.col("id").cast("string").alias("id"), "normal")  # as strings ids may be null
    schema = f"id string, alias string, {WINDOW}"
    if near.count() <= few:
        shared = spark.sparkContext.broadcast((near.toPandas(), aliases))

        def at_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            spans_of = TextSpans(*shared.value)
            for batch in batches:
                yield from _by_text(batch, spans_of)

        found = mine.mapInPandas(at_texts, schema)
    else:
        shared = spark.sparkContext.broadcast(aliases)
        parts = max(spark.sparkContext.defaultParallelism, -(-mine.count() // TEXTS))
        dealt = stored(mine.select(F.pmod(F.xxhash64("normal"), F.lit(parts)).cast("int").alias("part"), "id", "normal"))
        said = dealt.select(F.col("part").alias("of"), F.explode_outer(F.array_distinct(tokens(F.col("normal")))).alias("word")).distinct()

        def at_parts(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
            found = list(_by_text(texts, TextSpans(words, shared.value)))
            return pd.concat(found) if found else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

        own = said.join(near, "word").repartition(parts, "of")  # as many tasks as parts, though they are few bytes
        found = dealt.repartition(parts, "part").groupBy("part").cogroup(own.groupBy("of")).applyInPandas(at_parts, schema)
    return found.withColumn("id", F.col("id").cast(kind)).join(F.broadcast(names.select("alias", "code").distinct()), "alias")


def _best_of_surroundings(around: DataFrame) -> DataFrame:
    """The same from found words with their surroundings, a row for each found word."""
    kind = "local double, start int, size int, coverage double, precision double, mean double, worst double, by_sound boolean, taken array<int>, window string"

    @F.pandas_udf(kind)
    def aligned(alias: pd.Series, around: pd.Series) -> pd.DataFrame:
        alias = alias.reset_index(drop=True)
        out = pd.DataFrame(index=alias.index, columns=[c.split()[0] for c in kind.split(", ")])
        sizes = alias.map(len)
        for n in sizes.unique():
            index = np.flatnonzero(sizes == n)
            middle = n + EXTRA - 1
            shape = (len(index), 2 * middle + 1)
            similar, sound, weight = np.zeros((*shape, n)), np.zeros((*shape, n), dtype=bool), np.zeros(shape)
            words = np.full(shape, "", dtype=object)
            for r, k in enumerate(index):
                tokens_of = list(alias.iloc[k])
                for x in around.iloc[k]:
                    at = middle + x["at"]
                    words[r, at], weight[r, at] = x["word"], 0.10 if x["word"] in little else 0.60
                    for y in x["like"]:
                        for t, w in enumerate(tokens_of):
                            if w == y["alias_word"]:
                                similar[r, at, t], sound[r, at, t] = y["similarity"], y["by_sound"]
            best = best_windows(similar, sound, weight, n)
            best["window"] = np.asarray([" ".join(words[r, s : s + z]) for r, (s, z) in enumerate(zip(best["start"], best["size"], strict=True))], dtype=object)
            best["start"] = best["start"] - middle
            taken = best.pop("taken")
            for name, value in best.items():
                out.iloc[index, out.columns.get_loc(name)] = value
            column = out.columns.get_loc("taken")
            for r, k in enumerate(index):
                out.iat[k, column] = (np.flatnonzero(taken[r]) - middle).tolist()
        return out.astype({"local": float, "start": int, "size": int, "coverage": float, "precision": float, "mean": float, "worst": float, "by_sound": bool})

    little = frozenset(LITTLE)
    held = around.select("id", "code", "alias", "pos", aligned.asNondeterministic()("alias_tokens", "around").alias("a")).where("a.local >= 0")  # else the filter asks once more
    place, matched = F.col("pos") + F.col("a.start") + 1, F.transform("a.taken", lambda x: x + F.col("pos") + 1)
    return held.select("id", "code", "alias", place.alias("place"), matched.alias("matched"), *[F.col(f"a.{c}").alias(c) for c in ("local", "size", "coverage", "precision", "mean", "worst", "by_sound", "window")])


def spans(texts: DataFrame, aliases: DataFrame, least: float = 0.60, few: int = FEW, few_near: int = FEW) -> DataFrame:
    """``id, code, alias, place, size, matched, coverage, precision, score``: stretches of texts that say an alias, not only word for word.

    Where a word of a text is near one of the alias's words of content (any of its words, if it has none; see ``fuzzy``),
    the windows over that word, of up to four words more than the alias, are tried; the best of a text and alias counts,
    the shorter and then the earlier of equally good ones. Its score is 0.40 of the share of the alias's words, 0.25 of the
    weighted share of the window's, 0.20 of their harmonic mean and 0.15 of the words' mean similarity, at least 0.95 for
    the exact phrase, plus a bonus for windows that read alike as a whole. It is accepted as an exact phrase, with all
    words at 0.80, with over two thirds of them (``ENOUGH``) at a mean of 0.78, or reading alike; a word that only sounds alike needs the
    whole alias. Null and empty texts have none; ids should tell texts apart.

    Up to ``few`` aliases are sent to the texts: windows are tried where the words are, and only of aliases that a text may
    hold (``places_to_try``), so no more than the best window of a text and alias travels. Up to ``few_near`` near words are sent
    there too; more of them go to the parts of the texts that have them. Of more aliases a found word travels with its
    surroundings, never a text.
    """
    spark, names = texts.sparkSession, alias_words(aliases)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work
    texts = texts.select("id", "text").repartition(tasks)
    mine = prepared(texts)
    near = fuzzy(distinct_words(texts), aliases)
    near = stored(near.select("word", "alias_word", "similarity", (F.col("tier") == "phonetic").alias("by_sound")))
    content = F.filter("alias_tokens", lambda w: ~w.isin(*GRAMMAR))
    looked_up = F.when(F.size(content) > 0, content).otherwise(F.col("alias_tokens"))
    most, count = names.agg(F.coalesce(F.max("n_alias"), F.lit(0)), F.count("*")).first()
    if count <= few:
        held = _best_at_texts(mine, names, near, looked_up, few_near)
    else:
        heads = names.select("alias", "code", "alias_tokens", "n_alias", F.explode(F.array_distinct(looked_up)).alias("alias_word"))
        heads = heads.join(near, "alias_word").select(F.col("word").alias("head"), "alias", "code", "alias_tokens", "n_alias").distinct()
        held = _best_of_surroundings(_around_by_shuffle(mine, heads, near, most + EXTRA - 1))
    first = F.struct(F.round("local", 9).alias("local"), (-F.col("size")).alias("small"), (-F.col("place")).alias("early"), *[c for c in held.columns if c not in ("id", "code", "alias", "local", "place")])
    best = held.groupBy("id", "code", "alias").agg(F.max(first).alias("m")).select("id", "code", "alias", (-F.col("m.early")).alias("place"), *[F.col(f"m.{c}").alias(c) for c in ("size", "coverage", "precision", "mean", "worst", "by_sound", "window", "matched")])
    c, p, mean, semantic = F.col("coverage"), F.col("precision"), F.col("mean"), F.col("semantic")
    best = best.withColumn("semantic", token_sort_ratio("window", "alias"))
    exact_phrase = F.col("window").contains(F.col("alias"))
    lexical = 0.40 * c + 0.25 * p + 0.20 * F.try_divide(2 * c * p, c + p) + 0.15 * mean
    bonus = F.when((c >= 0.50) & (semantic >= 0.85), 0.16).when((semantic >= 0.78) & (c >= 0.67), 0.12).when((semantic >= 0.72) & (c >= 0.67), 0.07).otherwise(0.0)
    score = F.least(F.lit(1.0), F.when(exact_phrase, F.greatest(lexical, F.lit(0.95))).otherwise(lexical) + bonus)
    accepted = exact_phrase | ((c >= 1) & (F.col("worst") >= 0.80)) | ((c >= ENOUGH) & (mean >= 0.78)) | ((c >= ENOUGH) & (semantic >= 0.72))
    valid = accepted & (~F.col("by_sound") | (c >= 1)) & (score >= least)
    return best.where(valid).select("id", "code", "alias", "place", "size", "matched", F.round(c, 6).alias("coverage"), F.round(p, 6).alias("precision"), F.round(score, 6).alias("score"))


def strongest(found: DataFrame) -> DataFrame:
    """Of ``spans``, without those whose words are a part of another's that scores at most 0.04 less, the best of each code in a text."""
    found = stored(found)  # both sides of the join read it
    a, b = found.alias("a"), found.alias("b")
    within = (F.size("b.matched") > F.size("a.matched")) & (F.size(F.array_except("a.matched", "b.matched")) == 0) & (F.col("b.score") >= F.col("a.score") - 0.04)
    kept = a.join(b, (F.col("a.id") == F.col("b.id")) & within, "left_anti")
    best = kept.groupBy("id", "code").agg(F.max(F.struct("score", (-F.col("place")).alias("_neg"), "alias", "place", "size", "matched", "coverage", "precision")).alias("m"))
    return best.select("id", "code", *[f"m.{c}" for c in ("alias", "place", "size", "matched", "coverage", "precision", "score")])


class NameBounds:
    """What the names of classes can score at most with a text, and the scores of those that may be among the best.

    Letters that two strings share in order, one behind the other in both, are pairs of letters that both hold. Of L
    shared letters all but as many as such pairs are apart in one of the strings, so L <= (length + length + 1 + pairs) / 3.
    For all names at once pairs are counted over the text; for those that this leaves, over each stretch of the text as
    long as the name. Pairs within words, blanks included, are the same in any order of the words.
    """

    def __init__(self, labels: list[str], bias: dict[str, tuple[str, ...]]):
        self.labels, self.names = labels, [x.lower() for x in labels]
        self.bias = [(w, np.asarray([x in names for x in labels], dtype=bool)) for w, names in bias.items()]
        self.length = np.asarray([len(x) for x in self.names], dtype=np.int64)
        self.sets = [set(x.split()) for x in self.names]
        self.in_words = np.asarray([sum(map(len, s)) + max(len(s) - 1, 0) for s in self.sets], dtype=np.int64)
        self.number: dict[str, int] = {}
        of, pairs = [], []
        self.holders: dict[str, list[int]] = {}
        for i, x in enumerate(self.names):
            padded = f" {' '.join(sorted(self.sets[i]))} "
            for at, text in ((i, x), (i + len(labels), padded)):
                for pair in (text[j : j + 2] for j in range(len(text) - 1)):
                    of.append(at)
                    pairs.append(self.number.setdefault(pair, len(self.number)))
            for w in self.sets[i]:
                self.holders.setdefault(w, []).append(i)
        self.of, self.pairs = np.asarray(of, dtype=np.int64), np.asarray(pairs, dtype=np.int64)
        self.sorted = [" ".join(sorted(x)) for x in self.sets]
        letters = sorted({c for x in self.names if len(x) <= 63 for c in x})
        self.letter = np.zeros(max(map(ord, letters), default=0) + 2, dtype=np.int32)  # numbers of the names' letters, 0 of any other
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.masks = np.zeros((len(self.names), len(letters) + 1), dtype=np.uint64)  # where in a name a letter stands
        for i, x in enumerate(self.names):
            for j, c in enumerate(x if len(x) <= 63 else ""):
                self.masks[i, self.letter[ord(c)]] |= np.uint64(1 << j)

    def most(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """At least the partial ratio and the set ratio of every name."""
        held = np.zeros(len(self.number) + 1, dtype=np.int64)
        words = set(text.split())
        padded = f" {text} "
        for pair in {x + y for x, y in zip(padded, padded[1:], strict=False)} | {w[-1] + " " for w in words} | {" " + w[0] for w in words}:
            held[self.number.get(pair, -1)] = 1
        held[-1] = 0
        shared = np.bincount(self.of, weights=held[self.pairs], minlength=2 * len(self.labels)).astype(np.int64)
        n = self.length
        partial_most = partial_bound(np.minimum(n, len(text)), shared[: len(n)])
        size = sum(map(len, words)) + max(len(words) - 1, 0)
        letters = np.minimum(np.minimum(self.in_words, size), (self.in_words + size + 1 + shared[len(n) :]) // 3)
        set_most = np.where((self.in_words > 0) & (size > 0), 2.0 * letters / np.maximum(self.in_words + size, 1), 0.0)
        for w in words:
            for i in self.holders.get(w, ()):
                set_most[i] = 1.0
        return partial_most, set_most

    def plus(self, text: str) -> np.ndarray:
        return sum((45.0 * mask for w, mask in self.bias if w in text), np.zeros(len(self.labels)))

    def partials(self, text: str, which: np.ndarray) -> np.ndarray:
        """The partial ratio of the names of numbers ``which``: ``Letters.partial``, for all names of a length and a stretch of text at once.

        Names of up to 16 letters take 16 bits, of up to 32 and of up to 63 as many as they need; longer names, and those
        longer than the text, are compared one by one.
        """
        out = np.zeros(len(which))
        size = len(text)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        of = self.letter[np.minimum(codes, len(self.letter) - 1)]
        lengths = self.length[which]
        for n in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == n)
            if not 0 < n <= min(63, size):
                out[rows] = [Letters(text).partial(self.names[i]) for i in which[rows].tolist()]
                continue
            kind = np.uint16 if n <= 16 else np.uint32 if n <= 32 else np.uint64
            full = kind((1 << n) - 1)
            masks = np.ascontiguousarray(self.masks[which[rows]].T.astype(kind))
            padded = np.concatenate([np.zeros(n - 1, dtype=of.dtype), of, np.zeros(n - 1, dtype=of.dtype)])  # no character stands at either end
            count = len(padded) - n + 1
            best = np.zeros(len(rows))
            for low in range(0, count, STRETCHES):
                high = min(count, low + STRETCHES)
                held = np.take(masks, padded[low : high + n - 1], axis=0)
                bits = np.full((high - low, len(rows)), full)
                met, more = np.empty_like(bits), np.empty_like(bits)
                for i in range(n):  # what is carried beyond n bits is dropped behind the last letter
                    np.bitwise_and(bits, held[i : i + high - low], out=met)
                    np.add(bits, met, out=more)
                    np.subtract(bits, met, out=met)
                    np.bitwise_or(more, met, out=bits)
                missed = np.bitwise_count(np.bitwise_and(bits, full, out=bits))
                whole = slice(max(0, n - 1 - low), max(0, count - n + 1 - low))  # others are shorter, at either end
                if len(inner := missed[whole]):
                    best = np.maximum(best, 2.0 * (n - inner.min(axis=0).astype(np.int64)) / (n + n))
                for outer, first in ((missed[: whole.start], low), (missed[whole.stop :], low + whole.stop)):
                    if len(outer):
                        at = np.arange(first, first + len(outer))
                        length = np.minimum(np.minimum(at + 1, n), count - at)
                        best = np.maximum(best, (2.0 * (n - outer.astype(np.int64)) / (n + length[:, None])).max(axis=0))
            out[rows] = best
        return out

    def set_ratios(self, text: str, which: np.ndarray) -> list[float]:
        """``set_ratio`` of names and text: where they share no word the text's words are the same for all names."""
        words = set(text.split())
        joined = " ".join(sorted(words))
        size, full = len(joined), (1 << len(joined)) - 1
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        masks: dict[str, int] = {}
        out = []
        for i in which.tolist():
            mine = self.sets[i]
            if not mine or not words or mine & words:
                out.append(set_ratio(mine, words))
                continue
            one, rows = self.sorted[i], full
            for x in one:
                if x not in masks:
                    masks[x] = int.from_bytes(np.packbits(codes == ord(x), bitorder="little").tobytes(), "little")
                met = rows & masks[x]
                rows = ((rows + met) | (rows - met)) & full
            out.append(2.0 * (size - rows.bit_count()) / (len(one) + size))
        return out

    def best(self, text: str, k: int) -> tuple[list[tuple[float, str]], int]:
        """The ``k`` best of (score, label), by score and then label, and how many names were compared letter by letter.

        Names are compared in groups that grow, those with the highest bounds first.
        """
        plus, (partials, sets) = self.plus(text), self.most(text)
        most = 40 * partials + 60 * sets + plus + 1e-6
        order = np.argsort(-most, kind="stable")
        found: list[tuple[float, str]] = []
        at, step, compared = 0, k + 3, 0
        while at < len(order):
            which = order[at : at + step]
            if len(found) >= k:
                which = which[most[which] >= -found[k - 1][0]]
                if not len(which):
                    break
            compared += len(which)
            scores = zip(self.partials(text, which).tolist(), self.set_ratios(text, which), which.tolist(), strict=True)
            found = sorted([*found, *((-round(40 * p + 60 * s + plus[i], 6), self.labels[i]) for p, s, i in scores)])[:k]
            at, step = at + step, 8 * step
        return [(-s, label) for s, label in found[:k]], compared


def keyword_ranking(texts: DataFrame, classes: DataFrame, bias: dict[str, tuple[str, ...]], k: int = 5) -> DataFrame:
    """``id, label, probability, rank``: classes whose names read like a text, where nothing better is known.

    0.4 of the partial and 0.6 of the token-set ratio of name and text, from 0 to 100, and 45 for each keyword of ``bias``
    that is in the text and speaks for the class; of the ``k`` best, shares of these scores (at least 10 each). Null texts
    have no rows. ``classes`` (``label``, null ones left out) is a dimension of at most ``FEW`` names, which are broadcast;
    of each text only those names are compared whose upper bound (``NameBounds``) reaches its best ones. Texts are dealt out
    evenly, since a file of few row groups would leave the work to few tasks.
    """
    labels = [r[0] for r in classes.select("label").where("label is not null").distinct().orderBy("label").limit(FEW + 1).collect()]
    if len(labels) > FEW:
        raise ValueError(f"more than {FEW} classes")
    shared = texts.sparkSession.sparkContext.broadcast((labels, bias))

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bounds = NameBounds(*shared.value)
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                top = bounds.best(text, k)[0]
                total = sum(max(s, 10.0) for s, _ in top)
                rows += [(key, label, math.floor(max(s, 10.0) / total * 10_000 + 0.5) / 10_000, i) for i, (s, label) in enumerate(top, 1)]
            yield pd.DataFrame(rows, columns=["id", "label", "probability", "rank"]).astype({"rank": "int32", "probability": "float64"})

    kind = texts.schema["id"].dataType.simpleString()
    spark = texts.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work
    dealt = texts.select("id", F.lower("text").alias("text")).where("text is not null").repartition(tasks)
    return dealt.mapInPandas(rank, f"id {kind}, label string, probability double, rank int")


def conflicting(found: DataFrame, by: str = "id") -> DataFrame:
    """``by, code, affirmed, denied``: codes that are both affirmed and denied within one ``by``, and how often each.

    An intersection in one pass: counts are summed up before the shuffle, so the matches of a frequent code never meet.
    """
    said = found.groupBy(by, "code").agg(F.count(F.when(~F.col("negated"), 1)).alias("affirmed"), F.count(F.when(F.col("negated"), 1)).alias("denied"))
    return said.where("affirmed > 0 AND denied > 0")


def last_polarity(found: DataFrame) -> DataFrame:
    """``conv, code, positive, turn``: what was said last of each code in a conversation; within a turn a denial wins."""
    return found.groupBy("conv", "code").agg(F.max(F.struct("turn", F.col("negated"))).alias("m")).select("conv", "code", (~F.col("m.negated")).alias("positive"), F.col("m.turn").alias("turn"))
