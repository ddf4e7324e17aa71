"""Span alignment against a search of all texts and aliases, question ranking by hand, merging of recommendations, path attributions."""

import itertools
import random

import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import cases, fusion, lookups, matching, questions, serving
from tidemark.plans import language
from tidemark.sources import readers

SAID = [
    (1, "I have fever."), (2, "I feel short of breath."), (3, "I am having difficlty breathing."), (4, "I have been coughing up blood."), (5, "I have been caughing up blud."), (6, "I have a cough with yellow sputum."),
    (7, "my pain is in the chest"), (8, None), (9, ""), (10, "I have a headache."),
]
ALIASES = [("fever", "F"), ("shortness of breath", "S"), ("difficulty breathing", "S"), ("coughing up blood", "B"), ("cough", "C"), ("yellow sputum", "Y"), ("chest pain", "P"), ("headache", "H"), ("dizziness", "D")]


@pytest.fixture(scope="module")
def found(spark):
    texts, aliases = spark.createDataFrame(SAID, "id long, text string"), spark.createDataFrame(ALIASES, "alias string, code string")
    return matching.spans(texts, aliases)


def test_spans_of_sentences(found):
    best = {(r.id, r.code): r for r in matching.strongest(found).collect()}
    got = {}
    for i, code in best:
        got.setdefault(i, set()).add(code)
    assert got[1] == {"F"} and "S" in got[3] and got[4] == {"B"} and got[5] == {"B"} and got[6] == {"C", "Y"} and got[7] == {"P"} and got[10] == {"H"} and not {8, 9} & set(got)
    assert best[1, "F"].score == 1.0 and best[5, "B"].coverage == 1.0 and best[7, "P"].coverage == 1.0


def best_window(words, alias, similar, heads):
    """The window of at most four words more than the alias that fits it best, tried one after the other."""
    weight = lambda w: 0.10 if w in matching.LITTLE else 0.60
    best = None
    for size in range(1, min(len(words), len(alias) + matching.EXTRA) + 1):
        for start in range(len(words) - size + 1):
            window, used, got = words[start : start + size], [], []
            if not any(similar.get((w, a), 0) > 0 for w in window for a in heads):
                continue
            for a in alias:
                score, place = max(((similar.get((w, a), 0.0), -i) for i, w in enumerate(window) if i not in used), default=(0.0, 0))
                if score > 0:
                    used.append(-place)
                    got.append(score)
            coverage, mean = len(got) / len(alias), sum(got) / len(got)
            precision = sum(weight(window[i]) for i in used) / sum(map(weight, window))
            local = 0.50 * coverage + 0.30 * mean + 0.20 * precision - 0.035 * max(0, size - len(alias)) + (0.08 if coverage >= 1 else 0.0)
            if best is None or round(local, 9) > round(best[0], 9):
                best = local, start, size, coverage, precision, mean, sorted(start + i for i in used), min(got)
    return best


def nearness(spark, pairs):
    """How near the words of all pairs are, without any block."""
    words = sorted({w for p in pairs for w in p})
    frame = spark.createDataFrame([(w,) for w in words], "w string").select("w", matching.lemma(F.col("w")), text.sounds(F.col("w")))
    stem, code = {}, {}
    for w, x, y in frame.collect():
        stem[w], code[w] = x, y
    out = {}
    for w, a in pairs:
        long = min(len(w), len(a)) >= 4
        ratio = max(text.indel(x, y) for x in (w, stem[w]) for y in (a, stem[a])) if long else 0
        if w == a:
            out[w, a] = ("exact", 1.0)
        elif stem[w] == stem[a] or stem[w] == a or w == stem[a]:
            out[w, a] = ("lemma", 0.98)
        elif long and ratio >= 0.78:
            out[w, a] = ("edited", round(ratio, 6))
        elif long and w[0] == a[0] and code[w] == code[a] and text.indel(w, a) >= 0.45:
            out[w, a] = ("phonetic", 0.82)
    return out


def longest_by_table(a, b):
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        last = row
    return last[-1]


@given(st.text("abcd ", max_size=12), st.text("abcd ", max_size=80))
def test_ratios_by_bits(a, b):
    assert text.common(a, b) == text.common(b, a) == longest_by_table(a, b)
    short, long = sorted((a, b), key=len)
    if short:
        n = len(short)
        parts = [long[i : i + n] for i in range(len(long) - n + 1)] + [x for k in range(1, n) for x in (long[:k], long[-k:])]
        assert text.partial(a, b) == pytest.approx(max(2 * longest_by_table(short, x) / (n + len(x)) for x in parts), abs=1e-12)
    many = "xy" * 40 + a
    assert text.partial(many, b + many) == 1.0


def test_no_near_word_is_lost(spark):
    """Words of one, two and three edits, at either end and in the middle, against all pairs."""
    rng = random.Random(5)
    base = ["abdominally", "headache", "sputum", "dizziness", "cough", "of", "fever", "breathing", "pain", "abed", "walks", "walked", "otorhinolaryngologist"]
    words = {"zbdominallx", "walking", "dizzy"}
    for w in base:
        for _ in range(60):
            x = list(w)
            for _ in range(rng.randint(0, 4)):
                i = rng.randrange(len(x) + 1)
                rng.choice([lambda: x.insert(i, rng.choice("aeszt")), lambda: x and x.pop(min(i, len(x) - 1))])()
            words.add("".join(x))
    words.discard("")
    aliases = spark.createDataFrame([(w, w) for w in base], "alias string, code string")
    got = {(r.word, r.alias_word): (r.tier, r.similarity) for r in matching.fuzzy(spark.createDataFrame([(w,) for w in words], "word string"), aliases).collect()}
    want = nearness(spark, [(w, a) for w in words for a in base])
    assert ("zbdominallx", "abdominally") in want
    assert {k: (t, pytest.approx(s, abs=1e-6)) for k, (t, s) in want.items()} == got
    joined = matching.fuzzy(spark.createDataFrame([(w,) for w in words], "word string"), aliases, few=0).collect()
    assert {(r.word, r.alias_word): (r.tier, r.similarity) for r in joined} == got


def held_against_all_windows(spark, texts, aliases, found):
    words = {r.id: r.words for r in matching.prepared(texts).collect()}
    names = [(r.alias, r.alias_tokens) for r in matching.alias_words(aliases).select("alias", "alias_tokens").distinct().collect()]
    near = nearness(spark, list({(w, a) for ws in words.values() for w in ws for _, name in names for a in name}))
    similar = {k: s for k, (_, s) in near.items()}
    got = {(r.id, r.alias): r for r in found.collect()}
    accepted = 0
    for (i, ws), (alias, name) in itertools.product(words.items(), names):
        best = best_window(ws, name, similar, [a for a in name if a not in matching.GRAMMAR] or name)
        r = got.pop((i, alias), None)
        if best is None:
            assert r is None
            continue
        _, start, size, c, p, mean, used, worst = best
        window = " ".join(ws[start : start + size])
        semantic, exact = text.token_sort(window, alias), alias in window
        score = 0.40 * c + 0.25 * p + 0.20 * 2 * c * p / (c + p) + 0.15 * mean
        score = max(score, 0.95) if exact else score
        score += 0.16 if c >= 0.5 and semantic >= 0.85 else 0.12 if semantic >= 0.78 and c >= 0.67 else 0.07 if semantic >= 0.72 and c >= 0.67 else 0
        valid = exact or (c >= 1 and worst >= 0.8) or (c >= 0.67 and mean >= 0.78) or (c >= 0.67 and semantic >= 0.72)
        sounding = any(near.get((ws[j], a), ("", 0))[0] == "phonetic" for j in used for a in name)
        if not sounding or c >= 1:
            assert (r is not None) == (valid and min(1.0, score) >= 0.6), (i, alias, best)
        if r:
            accepted += 1
            assert (r.place, r.size, r.matched) == (start + 1, size, [j + 1 for j in used]) and r.score == pytest.approx(min(1.0, score), abs=2e-6)
    assert not got
    return accepted


def test_every_span_of_sentences(spark, found):
    texts, aliases = spark.createDataFrame(SAID, "id long, text string"), spark.createDataFrame(ALIASES, "alias string, code string")
    assert held_against_all_windows(spark, texts, aliases, found) >= 10
    # sent with their surroundings where aliases are many
    assert sorted(map(repr, matching.spans(texts, aliases, few=0).collect())) == sorted(map(repr, found.collect()))
    assert sorted(map(repr, matching.contained(texts, aliases, few=0).collect())) == sorted(map(repr, matching.contained(texts, aliases).collect()))


def test_every_span_of_documents(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 700").select(F.col("doc_id").alias("id"), "text").orderBy("id").limit(25)
    aliases = language._phrases(spark, sf).limit(12)
    words = texts.select(F.concat_ws(" ", F.slice(F.split(F.lower("text"), " "), 3, 3)).alias("alias"), F.col("id").cast("string").alias("code"))
    aliases = aliases.unionByName(words)
    assert held_against_all_windows(spark, texts, aliases, matching.spans(texts, aliases)) > 5


def test_spans_where_near_words_are_many(spark, found):
    """Near words that are dealt to the texts that have them, in place of a broadcast; a text without an id."""
    texts, aliases = spark.createDataFrame([*SAID, (None, SAID[0][1])], "id long, text string"), spark.createDataFrame(ALIASES, "alias string, code string")
    sent, dealt = (sorted(map(repr, matching.spans(texts, aliases, few_near=n).collect())) for n in (matching.FEW, 0))
    assert sent == dealt and set(map(repr, found.collect())) < set(sent)


def test_only_places_that_may_be_best_are_tried(monkeypatch):
    """A word that is everywhere brings no windows of its own where the whole alias is said better, nor of aliases that a text can't hold."""
    rows = []
    scored = matching.best_windows
    monkeypatch.setattr(matching, "best_windows", lambda similar, *rest: rows.append(len(similar)) or scored(similar, *rest))
    words = [*["pain", "x"] * 500, "sharp", "pain", "tonight", *["pain", "y"] * 500]
    near = pd.DataFrame([(w, w, 1.0, False) for w in ("pain", "sharp", "tonight")], columns=["word", "alias_word", "similarity", "by_sound"])
    aliases = [("sharp pain tonight", ["sharp", "pain", "tonight"], ["sharp", "pain", "tonight"]), ("pain nowhere else", ["pain", "nowhere", "else"], ["pain", "nowhere", "else"])]
    (best,) = matching.TextSpans(near, aliases).best([words])
    assert best[:5] == (0, 0, 1.08, 1000, 3) and best[-1] == [1000, 1001, 1002] and sum(rows) < 20


def test_near_words_by_bits():
    """Many pairs at once, against one pair at a time: words above 63 letters, other letters, and none at all in common."""
    rng = random.Random(9)
    pick = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    said = [(w := pick(rng.randint(1, 70)), w[: rng.choice((4, 90))], rng.choice("ST")) for _ in range(300)]
    known = [(w[: rng.randint(1, 70)], w[:5], rng.choice("ST")) for w, *_ in said[:60]] + [("x" * 70, "x" * 69, "S")]
    known = list({k[0]: k for k in known}.values())
    lengths = frozenset(len(x) for k in known for x in k[:2])
    words = matching.NearWords(known, 0.78)
    got = [{(x["alias_word"], x["tier"], x["similarity"]) for x in row} for row in words.near(said, lengths)]
    want = [{(k[0], *n) for k in known if k[0] in matching._found(*w, words.index, 0.78, lengths) and (n := matching.nearness(w, k, 0.78))} for w in said]
    assert got == want and sum(map(len, got)) > 100 and {x[1] for row in got for x in row} == {"exact", "lemma", "edited", "phonetic"}


def test_names_that_read_like_texts(spark):
    """Against all names, and with fewer comparisons than there are pairs."""
    rng = random.Random(3)
    labels = [f"{a} {b}" for a in ("blue", "small", "steel", "heavy", "bright", "cedar") for b in ("bolt", "ring", "anchor", "lantern", "saddle", "x")]
    texts = [rng.choice(labels).replace("e", rng.choice("ea")) + " was " + " ".join(rng.choice(labels)[:: rng.choice([1, -1])] for _ in range(rng.randint(0, 6))) for _ in range(60)] + ["", "x", "bolt", "a\nbolt  blue", None]
    bias = {"bolt": ("blue bolt", "small bolt")}
    bounds = matching.NameBounds(labels, bias)
    compared = 0
    for t in (t for t in texts if t is not None):
        all_of = sorted((-round(40 * text.partial(x, t) + 60 * text.token_set(x, t) + 45 * ("bolt" in t and x in bias["bolt"]), 6), x) for x in labels)
        letters, (a, b) = text.Letters(t), bounds.most(t)
        most = {x: (p, q) for x, p, q in zip(labels, a, b, strict=True)}
        for x in labels:
            assert most[x][0] >= text.partial(x, t) - 1e-9 and most[x][1] >= text.token_set(x, t) - 1e-9 and letters.partial_bound(x) >= text.partial(x, t) - 1e-9
        best, n = bounds.best(t, 5)
        assert best == [(-s, x) for s, x in all_of[:5]]
        compared += n
    assert compared < 0.7 * len(labels) * len(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = matching.keyword_ranking(frame, spark.createDataFrame([(x,) for x in [*labels, labels[0], None]], "label string"), bias).where("id = 62").orderBy("rank").collect()
    assert [r.label for r in rows[:2]] == ["blue bolt", "small bolt"] and sum(r.probability for r in rows) == pytest.approx(1, abs=1e-3)
    assert matching.keyword_ranking(frame, frame.select(F.lit(None).cast("string").alias("label")), bias).count() == 0


def test_question_parts(spark):
    items = [("A", "fever", "Do you have fever?", "B", None, False), ("B", "cough", "Do you cough at night?", "B", None, False), ("C", "smoke", "Do you smoke cigarette packs?", "B", None, True), ("D", "gen", "Anything related?", "B", None, False), ("E", "old", "Did you have surgery once?", "B", None, True), ("V", "level", "How much?", "C", ["1"], False), ("N", "none", "", "B", None, False)]
    ontology = spark.createDataFrame(items, "code string, name string, question string, data_type string, values array<string>, antecedent boolean")
    roles = {r.code: r.role for r in questions.described(ontology).collect()}
    assert roles == {"A": "symptom", "B": "symptom_detail", "C": "risk", "D": "generic", "E": "history", "V": "value", "N": "symptom"}
    graph = spark.createDataFrame([("A", x, 20, 0.4, 0.4, 0.3, 0.5) for x in "BCDENV"] + [("A", "Z", 5, 0.9, 0.9, 0.9, 0.9)], "a string, b string, pair_count long, conditional double, reverse double, jaccard double, association double")
    known = spark.createDataFrame([(1, "A", True), (1, "E", False), (2, "A", False)], "conv long, code string, positive boolean")
    rows = {r.candidate: r for r in questions.ranked(known, graph, ontology).collect()}
    assert set(rows) == {"B", "C", "D", "V"}  # E is known, N has no question, Z is too rare, conversation 2 has nothing positive
    score = 0.24 * 0.5 + 0.20 * 0.4 + 0.08 * 0.3 + 0.12 + 0.10 * 1 + 0.10 * (0.45 + 0.55 * 2 / 7) + 0.08 * 0.95 + 0.04 * 1 - 0.08
    assert rows["B"].score == pytest.approx(score, abs=1e-5) and rows["B"].rank == 1
    risk = 0.24 * 0.5 + 0.20 * 0.4 + 0.08 * 0.3 + 0.12 + 0.10 + 0.10 * (0.45 + 0.55 * 3 / 7) + 0.08 * 0.42 + 0.04 - 0.18 - 0.10
    assert rows["C"].score == pytest.approx(risk, abs=1e-5)
    gate = {r.conv: (r.n_positive, r.enough) for r in questions.sufficient(known).collect()}
    assert gate == {1: (1, False), 2: (0, False)}
    near = spark.createDataFrame([(1, "A", 0.9, 1.0), (1, "B", 0.6, 0.7), (1, "C", 0.54, 1.0), (1, "D", 0.9, 0.5), (1, "E", 0.8, 0.8)], "id long, code string, score double, coverage double")
    assert [r.code for r in questions.near_misses(near, ontology, spark.createDataFrame([(1, "E")], "id long, code string")).orderBy("rank").collect()] == ["A", "B"]


def test_merging(spark):
    people = spark.createDataFrame([(1,), (2,), (3,)], "entity long")
    conditions = spark.createDataFrame([(1, "Renal function", 0.5)], "entity long, name string, score double")
    signals = spark.createDataFrame([(1, "Creatinine", "HIGH"), (1, "BMI", "NORMAL"), (2, "Glucose", "NORMAL")], "entity long, kind string, abnormality string")
    protocols = fusion.biomarker_protocols(signals, spark.createDataFrame([(3, None, None)], "entity long, risk double, band string"))
    got = [(r.entity, r.name.split()[0], r["rank"]) for r in fusion.merged_recommendations(people, conditions, protocols).orderBy("entity", "rank").collect()]
    assert got == [(1, "Metabolic", 1), (1, "Renal", 2), (2, "Preventive", 1), (3, "Preventive", 1)]


def test_fields(spark, tmp_path):
    (tmp_path / "a.txt").write_text("k,v\n1,2\n")
    assert readers.csv_found(spark, str(tmp_path / "a"), "k int, v int").collect() == [(1, 2)]
    one = spark.range(1).select(lookups.first_date(F.lit("Report Date: 03/04/2021, printed 2020-01-01")).alias("a"), lookups.first_date(F.lit("date: March 5, 2021")).alias("b"), lookups.first_date(F.lit("31-12-1970")).alias("c"), text.pain_value(F.lit("The pain intensity is 7/10"), "intensity").alias("d"), text.pain_value(F.lit("intensity of the level is 7"), "intensity").alias("e")).first()
    assert [str(x) for x in one] == ["2021-04-03", "2021-03-05", "None", "7", "None"]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, status string")
    assert serving.with_status(rows, "all").count() == 2 and serving.with_status(rows, "a").count() == 1 and rows.where(serving.same_text("status", "A")).count() == 1
    people = cases.person(spark.createDataFrame([(1, 30.0, "Male"), (2, -1.0, "?")], "case_id long, age double, sex string"), spark.createDataFrame([(20.0, 5.0)], "age_mean double, age_std double"))
    assert sorted(tuple(r) for r in people.collect()) == [(1, 2.0, 1), (2, None, None)]
