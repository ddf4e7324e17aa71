"""Answers that expire, sketches of distinct values, names of measurements, profiles of conditions, places of pain: known answers and edges."""

import datetime as dt
import random

import pytest

from tidemark.operators import lab_lines, locations, lookups, matching
from tidemark.streaming import caches, conversation, events

T0 = dt.datetime(2024, 1, 1)
ASKS, ANSWERS = "ask_id long, key string, ts timestamp", "key string, ts timestamp, status string, detail string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def by_hand(asks, answers, ttl):
    """The rule, row by row: the latest kept answer that is not older than the time to live."""
    out = []
    for ask, key, ts in asks:
        fit = [a for a in answers if key is not None and ts is not None and a[0] == key and a[2] in caches.KEPT and a[1] is not None and a[1] <= ts and (ts - a[1]).total_seconds() < ttl]
        best = max(fit, key=lambda a: (a[1], a[2], a[3] is not None, a[3] or ""), default=None)
        out.append((ask, best[2] if best else "MISS", best[3] if best else None, (ts - best[1]).total_seconds() if best else None))
    return sorted(out, key=repr)


def made(n_asks, n_answers, seed):
    r = random.Random(seed)
    key = lambda: r.choice(["a", "a", "b", "c", None])
    asks = [(i, key(), r.choice([at(r.randrange(0, 3000)), at(r.random() * 3000), None] if i % 9 == 0 else [at(r.randrange(0, 3000))])) for i in range(n_asks)]
    answers = [(key(), at(r.randrange(0, 3000)), r.choice(["FOUND", "NONE", "FAILED", None]), r.choice(["x", "y", None])) for _ in range(n_answers)]
    return asks + asks[:5], answers + answers[:5]


def rows(frame):
    return sorted(((r.ask_id, r.status, r.detail, r.age) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("ttl", [1, 60, 100, 5000])
def test_cache_against_the_rule(spark, ttl):
    asks, answers = made(200, 150, ttl)
    assert rows(caches.looked_up(spark.createDataFrame(asks, ASKS), spark.createDataFrame(answers, ANSWERS), ttl)) == by_hand(asks, answers, ttl)


def test_cache_bounds(spark):
    answers = spark.createDataFrame([("k", at(0), "FOUND", "d"), ("k", at(50), "FAILED", "e"), ("n", at(0), "NONE", None)], ANSWERS)
    asks = spark.createDataFrame([(1, "k", at(0)), (2, "k", at(99)), (3, "k", at(100)), (4, "k", at(-1)), (5, "n", at(1)), (6, "o", at(1)), (7, None, at(1))], ASKS)
    got = {r.ask_id: (r.status, r.detail) for r in caches.looked_up(asks, answers, 100).collect()}
    miss = ("MISS", None)
    assert got == {1: ("FOUND", "d"), 2: ("FOUND", "d"), 3: miss, 4: miss, 5: ("NONE", None), 6: miss, 7: miss}
    assert {r.status for r in caches.looked_up(asks, answers.limit(0), 100).collect()} == {"MISS"} and caches.looked_up(asks.limit(0), answers, 100).count() == 0


def test_stream_of_lookups_restarts_and_takes_late_answers(spark, tmp_path):
    """Three runs from one checkpoint; an answer that comes after the lookup, but before the watermark, still counts."""
    asks = [(i, "ab"[i % 2], at(40 * i)) for i in range(30)]
    answers = [("ab"[i % 2], at(30 * i + 1), ("FOUND", "NONE", "FAILED")[i % 3], str(i)) for i in range(40)]
    seen = []
    with conversation.state_store(spark):
        for step in range(3):
            lo, hi = 400 * step, 400 * (step + 1)
            spark.createDataFrame([a for a in asks if lo <= (a[2] - T0).total_seconds() < hi], ASKS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/asks")
            # answers lag by 90 seconds, within the delay of 100
            part = [a for a in answers if lo - 90 <= (a[1] - T0).total_seconds() < hi - 90 or (step == 2 and (a[1] - T0).total_seconds() >= hi - 90)]
            spark.createDataFrame(part, ANSWERS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/answers")
            read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}").withWatermark("ts", "100 seconds")
            out = caches.looked_up_stream(read("asks", ASKS), read("answers", ANSWERS), 120)
            query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            query.awaitTermination(120)
            seen.append(spark.read.schema(caches.FOUND).parquet(f"{tmp_path}/out").count())
    got = rows(spark.read.schema(caches.FOUND).parquet(f"{tmp_path}/out"))
    assert 0 < seen[0] < seen[1] < seen[2] == len(got)
    last = min(asks[-1][2], answers[-1][1]) - dt.timedelta(seconds=100)
    assert got == by_hand([a for a in asks if a[2] < last], answers, 120)


def test_sketches_of_three_batches(spark, tmp_path):
    """20,000 values of one key, half of them in two batches: the estimate is within the sketch's bound, few values are exact."""
    all_ = spark.range(30_000).selectExpr("'hot' AS k", "id % 20000 AS v", "timestamp_seconds(id) AS ts", "pmod(id, 3) AS part")
    few = spark.range(300).selectExpr("'few' AS k", "id % 40 AS v", "timestamp_seconds(id) AS ts", "pmod(id, 3) AS part")
    none = spark.range(6).selectExpr("'none' AS k", "cast(null as long) AS v", "timestamp_seconds(id) AS ts", "pmod(id, 3) AS part")
    for i in range(3):
        all_.unionByName(few).unionByName(none).where(f"part = {i}").drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/came")
        stream = spark.readStream.schema("k string, v long, ts timestamp").parquet(f"{tmp_path}/came")
        events.counted_apart(stream, f"{tmp_path}/counts", ("k",), "v")
    got = {r.k: (r.n, r.n_distinct) for r in events.apart(spark, f"{tmp_path}/counts", ("k",)).collect()}
    assert got["few"] == (300, 40) and got["none"] == (6, 0) and got["hot"][0] == 30_000
    assert abs(got["hot"][1] / 20_000 - 1) < 3 * 1.04 / 2**6
    assert len(list((tmp_path / "counts").glob("batch=*"))) == 3


def test_distinct_values_of_three_batches_are_exact(spark, tmp_path):
    """20,000 values of one key, half of them in two batches: what a sketch of any size only estimates."""
    hot = spark.range(30_000).selectExpr("'hot' AS k", "id % 20000 AS v", "timestamp_seconds(id) AS ts", "pmod(id, 3) AS part")
    none = spark.range(6).selectExpr("'none' AS k", "cast(null as long) AS v", "timestamp_seconds(id) AS ts", "pmod(id, 3) AS part")
    nameless = spark.range(9).selectExpr("cast(null as string) AS k", "id % 2 AS v", "timestamp_seconds(id) AS ts", "pmod(id, 3) AS part")
    for i in range(3):
        hot.unionByName(none).unionByName(nameless).where(f"part = {i}").drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/came")
        stream = spark.readStream.schema("k string, v long, ts timestamp").parquet(f"{tmp_path}/came")
        events.values_apart(stream, f"{tmp_path}/counts", ("k",), "v")
    got = {r.k: (r.n, r.n_distinct) for r in events.values_of(spark, f"{tmp_path}/counts", ("k",)).collect()}
    assert got == {"hot": (30_000, 20_000), "none": (6, 0), None: (9, 2)}


def test_distinct_users_of_many_are_those_of_the_sql(spark, tmp_path):
    """20,000 users a day: estimates differ from the counts."""
    import duckdb

    from tests.compare import difference
    from tidemark.plans import catalogue

    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) SECOND AS ts, i % 20000 AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{{}}' AS props FROM range(30000) r(i)) TO '{tmp_path}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert difference(catalogue.QUERIES["stream_distinct"](spark, str(tmp_path)), con.sql(catalogue.ORACLES["stream_distinct"])) is None


ALIASES = [
    ("glucose", "Glucose", True, 1), ("blood sugar", "Glucose", True, 2), ("urea", "Urea Nitrogen", True, 3), ("calcium", "Calcium", True, 4), ("total iron binding capacity", "Serum Iron", False, 5),
    ("sugar", "Sugar", False, 6), ("ldl/hdl ratio", "Ratio", False, 7), ("ph", "pH", False, 8),
]


@pytest.mark.parametrize("name, target, tier, confidence", [
    (" GLUCOSE* ", "Glucose", "exact", 1.0), ("Glucose.", "Glucose", "bare", 0.98), ("LDL/HDL  Ratio", "Ratio", "exact", 1.0), ("TSH - Ultrasensitive", "Thyroid Stimulating Hormone", "acronym", 0.95),
    ("SGPT (ALT)", "Alanine aminotransferase [Enzymatic activity/volume] in Serum or Plasma", "acronym", 0.95), ("Blood Sugar Fasting (FBS)", "Glucose", "acronym", 0.95), ("fasting blood sugar", "Glucose", "contained", 0.92),
    ("calciums", "Calcium", "contained", 0.92), ("ionised sugar", "Sugar", "contained", 0.92), ("serum urea", "Urea Nitrogen", "keyword", 0.90), ("urea x", "Urea Nitrogen", "overlap", 0.85), ("free haemoglobin", "Hemoglobin [Mass/volume] in Blood", "keyword", 0.90),
    ("ironic", None, None, None), ("iron binding total", "Serum Iron", "overlap", 0.64), ("capacity total", None, None, None), ("ph", "pH", "exact", 1.0), ("ph of it", "pH", "overlap", 0.85), ("phx", None, None, None), ("", None, None, None), ("?!", None, None, None), ("white  blood cells, all", "Leukocytes [#/volume] in Blood by Automated count", "keyword", 0.90)])
def test_measurement_names(told, name, target, tier, confidence):
    assert told[name] == (target, tier, confidence)


@pytest.fixture(scope="module")
def told(spark):
    names = [(m,) for mark in test_measurement_names.pytestmark for m, *_ in mark.args[1]]
    out = lookups.measurement_names(spark.createDataFrame([*names, *names[:3], (None,)], "name string"), spark.createDataFrame(ALIASES, "alias string, target string, canonical boolean, ordinal long")).collect()
    assert len(out) == len(set(names))
    return {r.name: (r.target, r.tier, r.confidence) for r in out}


def test_names_without_a_dictionary(spark):
    names, none = spark.createDataFrame([("TSH",), ("potassium",), ("glucose",)], "name string"), spark.createDataFrame([], "alias string, target string, canonical boolean, ordinal long")
    assert {r.name: r.tier for r in lookups.measurement_names(names, none).collect()} == {"TSH": "acronym", "potassium": "keyword", "glucose": None}
    assert lookups.measurement_names(names.limit(0), none).collect() == []


def test_condition_profiles(spark):
    known = spark.createDataFrame([("Viral flu", 1, "a", "x", False), ("Flu", 2, "b", "y", False), ("UTI", 3, "c", None, True), ("MI", 4, "d", "w", True)], "profile string, ordinal long, category string, description string, emergency boolean")
    asked = ["Flu", " FLU", "flu", "severe flu", "viral", "uti 2", "u", "mild", "xmi", "gout", "", None, "gout"]
    got = {r.name: (r.profile, r.tier, r.category, r.emergency) for r in lookups.condition_profiles(spark.createDataFrame([(a,) for a in asked], "name string"), known).collect()}
    flu = ("Flu", "folded", "b", False)
    assert got == {
        "Flu": ("Flu", "exact", "b", False), " FLU": flu, "flu": flu, "severe flu": ("Flu", "contained", "b", False), "viral": ("Viral flu", "contained", "a", False), "uti 2": ("UTI", "contained", "c", True), "u": ("Viral flu", "contained", "a", False),
        "mild": ("MI", "contained", "d", True), "xmi": ("MI", "contained", "d", True), "gout": ("gout", "general", "General Clinical", False), "Clinical Condition": ("Clinical Condition", "general", "General Clinical", False)}


def test_units_of_kinds_without_a_rule(spark):
    items = spark.createDataFrame([("sodium", 140.0, "mmol/L"), ("sodium", 140.0, None), ("other", 1.0, "x"), ("glucose", 5.0, "mmol/L"), (None, 2.0, "y")], "kind string, value double, unit string")
    units = spark.createDataFrame([("sodium", "mEq/L"), ("glucose", "no"), ("unseen", "z")], "kind string, unit string")
    got = sorted(map(tuple, lab_lines.converted(items, units).collect()), key=repr)
    assert got == sorted([("sodium", 140.0, "mEq/L"), ("sodium", 140.0, "mEq/L"), ("other", 1.0, "x"), ("glucose", 90.1, "mg/dL"), (None, 2.0, "y")], key=repr)


PLACES = [("V_1", "knee(R)", 1), ("V_2", "knee(L)", 2), ("V_3", "upper chest", 3), ("V_4", "lumbar spine", 4), ("V_5", "thoracic spine", 5), ("V_6", "Nasal passage", 6), ("V_7", "forearm (L)", 7), ("V_8", None, 8), ("V_9", "finger (index)", 9), ("V_10", " (R)", 10)]


def test_location_aliases(spark):
    got = {}
    for r in locations.location_aliases(spark.createDataFrame(PLACES, "value string, meaning string, ordinal int")).collect():
        got.setdefault(r.value, []).append(r.alias)
    assert all(len(v) == len(set(v)) for v in got.values())
    assert set(got["V_1"]) == {"knee r", "right knee", "knee", "joint", "joint pain", "knee pain", "aching joints", "painful joints"}
    assert set(got["V_7"]) == {"forearm l", "left forearm", "forearm", "left forearm muscle", "arm"}
    assert set(got["V_9"]) == {"finger index", "finger"} and set(got["V_6"]) == {"nasal passage"} and "lower back" in got["V_4"] and "lower back" in got["V_5"]
    assert "V_8" not in got and set(got["V_10"]) == {"r"}


def test_pain_locations(spark):
    said = ["my knee hurts", "pain in my left knee", "Pain: LEFT KNEE.", "my knee is fine", "lower back pain", "chest pain", "a painful nasal passage and knee", "pain", None, "", "the forearms ache", "arm ache", "my back, my lower back hurts"]
    want = [("V_1", "knee"), ("V_2", "left knee"), ("V_2", "left knee"), None, ("V_4", "lower back"), ("V_3", "chest pain"), ("V_6", "nasal passage"), None, None, None, None, ("V_7", "arm"), ("V_4", "lower back")]
    aliases = locations.location_aliases(spark.createDataFrame(PLACES, "value string, meaning string, ordinal int"))
    texts = spark.createDataFrame(list(enumerate(said)), "id long, text string")
    got = {r.id: (r.value, r.matched) for r in locations.pain_locations(texts, aliases).collect()}
    assert [got.get(i) for i in range(len(said))] == want
    assert locations.pain_locations(texts.limit(0), aliases).collect() == [] == locations.pain_locations(texts, aliases.limit(0)).collect()


def test_conflicts(spark):
    said = [(1, "I have a cough but no fever"), (1, "fever now, really"), (1, "a cough"), (2, "no cough"), (2, None), (3, "no fever, a fever")]
    texts = spark.createDataFrame([(10 * c + i, t) for i, (c, t) in enumerate(said)], "id long, text string")
    aliases = spark.createDataFrame([("cough", "C"), ("fever", "F")], "alias string, code string")
    found = matching.contained(texts, aliases).selectExpr("id div 10 AS conv", "code", "negated")
    assert [tuple(r) for r in matching.conflicting(found, "conv").collect()] == [(1, "F", 1, 1)]
