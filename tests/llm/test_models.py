"""Language identification and quality scoring: held-out accuracy, and what may not be looked at."""

import zlib

import numpy as np
import regex
from pyspark.sql import functions as F

from tidemark.llm import language_id, pu_quality, registry

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    rows = registry.op3_language_id(spark, SF).collect()
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()}
    assert len(rows) == len(truth)
    right = total = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        lang, text = truth[r.doc_id]
        if not text or not regex.search(r"\p{L}", text):
            assert r.lang_pred == "und"
        elif r.held_out and lang:
            right, total = right + (r.lang_pred == lang), total + 1
    assert right / total > 0.95


def test_language_ignores_other_columns(docs, nothing):
    model = language_id.fit(docs)
    a = {r.doc_id: tuple(r) for r in language_id.identify(docs, model).collect()}
    moved = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q"))
    assert a == {r.doc_id: tuple(r) for r in language_id.identify(moved, model).collect()}
    assert a[4][1:] == ("und", 0.0) and a[9][1] == "und"
    assert language_id.fit(nothing) is None and language_id.identify(nothing, None).collect() == []
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and not {4, 5, 6, 9} & {r.doc_id for r in kept.collect()}


def test_families_before_languages(docs):
    model = language_id.fit(docs)
    assert set(model.within) == set(model.family.names)
    assert all(language_id.FAMILY_OF.get(n, n) == f for f, m in model.within.items() for n in m.names)


def test_quality_held_out(spark):
    rows = {r.doc_id: r for r in registry.op8_pu_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    held = [(rows[x.doc_id].score, x.quality) for x in labels if rows[x.doc_id].held_out and x.quality is not None]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.85


def test_quality_of_other_texts(spark):
    """More texts: held-out order, beside that by the measures of the surface alone."""
    rows = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/labels.parquet")
    net = pu_quality.fit(rows, labels)
    scored = pu_quality.score(rows.where(~language_id.learnable("doc_id")), net).join(labels.where("quality is not null"), "doc_id").select("score", "quality").collect()
    good, bad = [r.score for r in scored if r.quality], [r.score for r in scored if not r.quality]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.9


def test_a_hot_id_leaves_the_draw_to_others(spark):
    rows = spark.range(600).selectExpr("id AS doc_id").unionByName(spark.range(2000).selectExpr("7L AS doc_id")).repartition(4)
    named = rows.selectExpr("doc_id", "1 AS _label").distinct()
    learnable = {r.doc_id for r in rows.where(language_id.learnable("doc_id")).collect()}
    for sample in (50, 5000):
        got = pu_quality.drawn(rows, named, "doc_id", sample).collect()
        for side in (True, False):
            ids = [r[0] for r in got if r[1] is side]
            assert len(ids) == len(set(ids)) == min(sample, len(learnable)) and set(ids) <= learnable


def test_prior_from_positives_alone():
    rng = np.random.default_rng(1)
    for prior in (0.2, 0.5, 0.8):
        good, bad = rng.normal(1.5, 1, (6000, 4)), rng.normal(-1.5, 1, (6000, 4))
        mixed = np.where(rng.random((6000, 1)) < prior, rng.normal(1.5, 1, (6000, 4)), bad)
        assert abs(pu_quality.estimated_prior(good, mixed) - prior) < 0.08


def test_steps_lower_the_non_negative_risk():
    """The fitted network's risk is below that of the empty one and of a plain logistic fit of positives against unlabelled."""
    rng = np.random.default_rng(2)
    p, u = rng.normal(1, 1, (800, 3)), np.vstack([rng.normal(1, 1, (600, 3)), rng.normal(-1, 1, (600, 3))])
    net = pu_quality.fit_network(p, u, 0.5)

    def risk(score):
        g = lambda x: np.log(np.clip(score(x), 1e-12, 1)) - np.log(np.clip(1 - score(x), 1e-12, 1))
        loss = lambda z: np.logaddexp(0, -z).mean()
        return 0.5 * loss(g(p)) + max(0.0, loss(-g(u)) - 0.5 * loss(-g(p)))

    w = np.zeros(4)
    x, y = np.column_stack([np.vstack([p, u]), np.ones(len(p) + len(u))]), np.repeat([1.0, 0.0], [len(p), len(u)])
    for _ in range(500):
        w += 0.5 * x.T @ (y - 1 / (1 + np.exp(-x @ w))) / len(x)
    plain = lambda z: 1 / (1 + np.exp(-(np.column_stack([z, np.ones(len(z))]) @ w)))
    assert risk(net.scores) < risk(plain) and risk(net.scores) < risk(lambda z: np.full(len(z), 0.5))


def test_quality_of_nothing(docs, nothing, spark):
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (3, None)], "doc_id long, quality int")
    net = pu_quality.fit(docs, labels)
    assert pu_quality.score(docs, net).count() == docs.count()
    assert pu_quality.score(nothing, net).collect() == []
    assert pu_quality.fit(docs, labels.where("false")) is None
    assert {r.score for r in pu_quality.score(docs, None).collect()} == {0.5}


def test_repeated_rows_and_labels(spark):
    """Repeated ids, rows and labels, null ids and empty texts: each row is predicted and scored as its text alone."""
    words = {"en": "the cat and the dog are in the house of the man ", "de": "der Hund und die Katze sind in dem Haus des Mannes "}
    rows = [(i % 40, words[lang] * (1 + i % 5), lang) for i in range(80) for lang in [("en", "de")[i % 2]]] + [(None, words["en"], "en"), (None, None, None), (7, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    out = language_id.identify(docs, language_id.fit(docs)).collect()
    assert len(out) == len(rows) and {r.lang_pred for r in out} == {"en", "de", "und"}
    labels = spark.createDataFrame([(i % 20, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    scored = pu_quality.score(docs, pu_quality.fit(docs, labels)).collect()
    assert len(scored) == len(rows) and len({r.score for r in scored}) <= 11


def plain_features(text):
    """Square roots of the shares of hashed byte trigrams, one trigram at a time."""
    raw = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in f" {text.lower()} ".encode())
    v = np.zeros(language_id.DIMS)
    for i in range(len(raw) - 2):
        if raw[i : i + 3] != b"   ":
            v[(int.from_bytes(raw[i : i + 3], "big") * 0x9E3779B1 % 2**32) >> (32 - 13)] += 1
    return np.sqrt(v / max(v.sum(), 1))


def plain_machine(x, labels):
    """One-versus-one squared-hinge machines, by accelerated descent on the weights themselves: ``{(a, b): weights}``."""
    out = {}
    for a in sorted(set(labels)):
        for b in sorted(set(labels)):
            if a < b:
                some = [i for i, n in enumerate(labels) if n in (a, b)]
                z, y = np.column_stack([x[some], np.ones(len(some))]), np.array([1.0 if labels[i] == a else -1.0 for i in some])
                cost = np.array([10.0 * 0.5 * len(y) / (y == one).sum() for one in y])
                step = 1 / (1 + np.linalg.norm(z * np.sqrt(cost)[:, None], 2) ** 2)
                w = ahead = np.zeros(z.shape[1])
                for _ in range(4000):
                    slack = np.maximum(0, 1 - y * (z @ ahead))
                    new = ahead - step * (ahead - z.T @ (cost * y * slack))
                    w, ahead = new, new + 0.95 * (new - w)
                out[a, b] = w
    return out


def plain_vote(machines, names, v):
    votes, sums = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
    for (a, b), w in machines.items():
        m = w[:-1] @ v + w[-1]
        votes[a if m >= 0 else b] += 1
        sums[a], sums[b] = sums[a] + m, sums[b] - m
    return max(sorted(names), key=lambda n: (votes[n], sums[n]))


def test_language_against_a_plain_fit(spark):
    """Every learnable text is learnt from and every text predicted as by a plain fit without Spark, tries or duals."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 600").select("doc_id", "text", "lang").collect()
    drawn = [r for r in rows if r.lang and r.text and regex.search(r"\p{L}", r.text) and zlib.crc32(str(r.doc_id).encode()) % 5]
    drawn = list({(r.doc_id, r.text): r for r in drawn}.values())
    assert len({r.lang for r in drawn}) >= 4 and max(sum(r.lang == x for r in drawn) for x in {r.lang for r in drawn}) <= language_id.PER_LANGUAGE
    x, langs = np.array([plain_features(r.text) for r in drawn]), [r.lang for r in drawn]
    families = [language_id.FAMILY_OF.get(n, n) for n in langs]
    between = plain_machine(x, families)
    within = {f: plain_machine(x[[g == f for g in families]], [n for n, g in zip(langs, families, strict=True) if g == f]) for f in set(families)}
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = language_id.fit(frame)
    for f, machine in within.items():
        for (a, b), w in machine.items():
            names = model.within[f].names
            at = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))].index((names.index(a), names.index(b)))
            assert np.abs(model.within[f].weights[at] - w).max() < 2e-3 * max(1, np.abs(w).max())
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(frame, model).collect()}
    want = set()
    for r in rows:
        if not r.text or not regex.search(r"\p{L}", r.text):
            want.add((r.doc_id, "und"))
            continue
        v = plain_features(r.text)
        family = plain_vote(between, set(families), v)
        want.add((r.doc_id, plain_vote(within[family], {n for n, g in zip(langs, families, strict=True) if g == family}, v)))
    assert got == want
