"""Worked examples with answers known by hand, and inputs at the edge of what operators accept."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.functions import text
from tidemark.operators import cases, cleaning, evaluation, features, fusion, lab_lines, ranking, splits, temporal, trajectory
from tidemark.sources import readers, sinks

OBS = "entity long, ts timestamp_ntz, kind string, value double, unit string"


def day(s):
    return dt.datetime.fromisoformat(s)


@pytest.fixture(scope="module")
def obs(spark):
    rows = [(1, day(d), k, v, "u") for d, k, v in (
        ("2025-05-01", "glucose", 195.0), ("2025-12-01", "glucose", 205.0), ("2026-02-01", "glucose", 218.0), ("2026-06-01", "glucose", 230.0),
        ("2025-05-01", "a1c", 8.3), ("2025-12-01", "a1c", 8.7), ("2026-06-01", "a1c", 9.0), ("2025-05-01", "egfr", 48.0), ("2026-06-01", "egfr", 35.0))]
    return spark.createDataFrame(rows, OBS)


def test_feature_block_training_and_serving(spark, obs):
    at = spark.createDataFrame([(1, day("2026-06-01"))], "entity long, snap_ts timestamp_ntz")
    train = {r.kind: r for r in features.long_block(at, obs, "train").collect()}
    g = train["glucose"]
    assert (g.n_long, g.latest, g.abs_change, g.days_since, g.mean_short) == (3, 230.0, 25.0, 0.0, 230.0)
    assert g.mean_long == pytest.approx(653 / 3) and g.std_long == pytest.approx(10.208929, abs=1e-5) and g.rel_change == pytest.approx(25 / 205) and g.slope_short is None
    assert train["egfr"].n_long == 1 and train["egfr"].std_long == 0.0 and train["egfr"].abs_change is None and train["egfr"].slope_long is None
    serve = {r.kind: r for r in features.long_block(at, obs, "serve").collect()}
    assert serve["glucose"].std_long == pytest.approx(12.5033329, abs=1e-5)
    assert serve["egfr"].std_long is None and serve["egfr"].abs_change == 0.0 and serve["egfr"].rel_change == 0.0


def test_trajectory(spark, obs):
    c = {"glucose": trajectory.Concern("higher", 5.0), "a1c": trajectory.Concern("higher", 0.2), "egfr": trajectory.Concern("lower", 3.0)}
    got = {r.kind: r for r in trajectory.by_kind(obs, c).collect()}
    assert (got["glucose"].status, got["glucose"].confidence, got["glucose"].days_covered, got["glucose"].points) == ("WORSENING", "HIGH", 396, 4)
    assert (got["egfr"].status, got["egfr"].confidence) == ("WORSENING", "MEDIUM")
    assert trajectory.overall(trajectory.by_kind(obs, c)).first().status == "WORSENING"


@pytest.mark.parametrize("times, label, first", [
    ([], 0, None), (["2020-01-01 00:00"], 0, None), (["2020-01-01 00:00:01"], 1, "2020-01-01 00:00:01"), (["2020-03-31 00:00"], 1, "2020-03-31 00:00"), (["2020-03-31 00:00:01"], 0, None),
    (["2020-01-01 00:00", "2020-02-01"], 1, "2020-02-01")])
def test_label_bounds(spark, times, label, first):
    points = spark.createDataFrame([(1, day("2020-01-01"))], "entity long, snap_ts timestamp_ntz")
    events = spark.createDataFrame([(1, day(t)) for t in times], "entity long, ts timestamp_ntz")
    row = temporal.forward_labels(points, events).first()
    assert (row.label, row.first_event) == (label, first and day(first))


@pytest.mark.parametrize("last, want", [("2024-06-29", ["2024-03-31", "2024-06-29"]), ("2024-06-28", ["2024-03-31"]), ("2024-03-30", [])])
def test_snapshot_series(spark, last, want):
    rows = spark.createDataFrame([(1, day("2024-01-01"), "k", 1.0, "u"), (1, day(last), "k", 1.0, "u")], OBS)
    cutoff = spark.createDataFrame([(day("2025-01-01"),)], "c timestamp_ntz")
    assert [r.snap_ts for r in temporal.snapshots(rows, cutoff=cutoff).orderBy("snap_ts").collect()] == [day(x) for x in want]


@pytest.mark.parametrize("n, k, want", [(10, 3, [0, 4, 9]), (6, 3, [0, 2, 5]), (4, 3, [0, 2, 3]), (3, 3, [0, 1, 2])])
def test_spaced_choice(spark, n, k, want):
    points = spark.range(n).select(F.lit(1).alias("entity"), F.col("id").alias("snap_ts"))
    assert sorted(r.snap_ts for r in temporal.spaced(points, F.lit(k)).collect()) == want


def test_hot_entity_is_spread_over_buckets(spark):
    points = spark.createDataFrame([(1, day("2020-01-01") + dt.timedelta(days=30 * i)) for i in range(100)], "entity long, snap_ts timestamp_ntz")
    events = spark.createDataFrame([(1, day("2020-01-01") + dt.timedelta(days=i)) for i in range(3000)], "entity long, ts timestamp_ntz")
    got = {r.snap_ts: r["count"] for r in temporal.range_join(points, events, 365, 0).groupBy("snap_ts").count().collect()}
    for i in range(100):
        at = 30 * i
        assert got[day("2020-01-01") + dt.timedelta(days=at)] == len([d for d in range(3000) if at - 365 <= d <= at])


@pytest.mark.parametrize("said, positive, negative", [
    ("I have fever.", {"fever"}, set()), ("I don't have fever.", set(), {"fever"}), ("I don't have fever but I have a cough.", {"cough"}, {"fever"}),
    ("I have fever but I do not have a cough.", {"fever"}, {"cough"}), ("Fever is absent.", set(), {"fever"}),
    ("Neither fever nor cough.", set(), {"fever", "cough"}), ("Lacks fever, instead a cough.", {"cough"}, {"fever"}), ("The fever was ruled out.", set(), {"fever"}), ("I dont have fever.", set(), {"fever"}),
    ("not a b c d e f fever", {"fever"}, set()), ("I won't have a fever", set(), {"fever"}), ("It wouldnt be a cough", set(), {"cough"}), ("I wont say but I'd say fever", {"fever"}, set())])
def test_negation(spark, said, positive, negative):
    from tidemark.operators import matching

    texts = spark.createDataFrame([(1, said), (2, None), (3, "")], "id long, text string")
    names = spark.createDataFrame([("fever", "fever"), ("cough", "cough")], "alias string, code string")
    rows = matching.contained(texts, names).collect()
    assert {r.code for r in rows if not r.negated} == positive and {r.code for r in rows if r.negated} == negative


def test_lab_lines(spark):
    lines = ["Blood Pressure: 135/88 mmHg", "Glucose: 5.5 mmol/L", "platelets 2.4 lakhs/cumm", "Creatinine 100 µmol/L", "HbA1c: 48 mmol/mol", "nothing here", None, ""]
    items = lab_lines.judged(lab_lines.converted(lab_lines.parsed(spark.createDataFrame(list(enumerate(lines)), "id long, line string"))))
    got = {(r.kind, r.value, r.unit) for r in items.collect()}
    assert got == {("systolic", 135.0, "mmHg"), ("diastolic", 88.0, "mmHg"), ("glucose", 99.1, "mg/dL"), ("platelets", 240.0, "10³/µL"), ("creatinine", 1.13, "mg/dL"), ("hba1c", 6.54, "%")}


@pytest.mark.parametrize("kind, value, unit, want", [
    ("HbA1c", 150.0, "mmol/mol", (15.87, "%")), ("hemoglobin a1c", 26.0, "", (4.53, "%")), ("HbA1c", 6.1, "", (6.1, "%")), ("Leukocytes in blood", 7600.0, "/cumm", (7.6, "10³/µL")), ("Leukocytes", 110.0, "x", (110.0, "10³/µL")),
    ("Leukocytes", 130.0, "x", (0.13, "10³/µL")), ("Leukocytes", 7.6, "/µL", (7.6, "10³/µL")), ("Platelet count", 250000.0, "/cumm", (250.0, "10³/µL")), ("Platelets", 2.5, "Lac/cumm", (250.0, "10³/µL")), ("HDL Cholesterol", 1.0, "mmol/L", (38.7, "mg/dL")),
    ("Triglycerides", 2.0, "mmol/l", (177.1, "mg/dL")), ("Bilirubin total", 20.0, "µmol/L", (1.17, "mg/dL")), ("Glucose", 90.0, "", (90.0, "mg/dL")), ("Sodium", 140.0, "mmol/L", (140.0, "mmol/L"))])
def test_units(spark, kind, value, unit, want):
    row = lab_lines.converted(spark.createDataFrame([(kind, value, unit)], "kind string, value double, unit string")).first()
    assert (row.value, row.unit) == want


def test_repeats_go_before_units_are_trimmed(spark):
    rows = [(1, day("2024-01-01"), "g", v, u) for v, u in ((1.0, "mg"), (1.0, "mg "), (4.0, "mg"), (4.0, "mg"))]
    row = cleaning.clean(spark.createDataFrame(rows, OBS)).first()
    assert (row.value, row.n_raw, row.unit) == (2.0, 3, "mg")


def test_reports(spark):
    lines = [(1, "Patient report"), (2, "B.P.: 135/88"), (3, "Glucose: 5.5 mmol/L H"), (4, "Haemoglobin      13.2   g/dL"), (5, "Sodium 140 mmol/L"), (6, "Creatinine"), (7, "1,2 mg/dL"), (8, "Glucose 7 mmol/L"), (9, None), (10, "120/80 mm Hg")]
    names = spark.createDataFrame([("glucose", "glucose"), ("Haemoglobin", "hb"), ("sodium", "na"), ("creatinine", "creatinine")], "alias string, kind string")
    rows = lab_lines.report_items(spark.createDataFrame([("d", *x) for x in lines], "doc string, no int, line string"), names).collect()
    got = {(r.kind, r.value, r.unit, r.line, r.confidence) for r in rows}
    assert got == {("systolic", 135.0, "mmHg", 2, 0.95), ("diastolic", 88.0, "mmHg", 2, 0.95), ("glucose", 99.1, "mg/dL", 3, 1.0), ("hb", 13.2, "g/dL", 4, 1.0), ("na", 140.0, "mmol/L", 5, 1.0), ("creatinine", 12.0, "mg/dL", 6, 0.9)}


def test_sound_codes_and_ratios(spark):
    words = {"pfister": "P123", "ashcraft": "A226", "": "", "blood": "B430", "blud": "B430", "A": "A000"}
    words["blood"] = words["blud"] = "B430"
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", text.sounds(F.col("w")).alias("s")).collect()}
    assert got == words
    assert text.partial("ab", "xxabxx") == 1.0 and text.token_set("a b", "b a c") == 1.0 and text.token_sort("b a", "a b") == 1.0 and text.partial("", "x") == 0.0
    assert text.indel("abc", "abd") == pytest.approx(4 / 6) and text.indel("", "") == 1.0 and text.indel("a", "") == 0.0


def test_validation_and_records(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"id": "p1", "observations": [{"observation": "g", "value": "5", "timestamp": "2024-01-02"}, {"name": "g", "value": "x", "date": "2024-01-02"}, {"name": "", "value": "1", "date": "2024-01-01"}]}')
    items = readers.measurement_items(readers.records(spark, str(tmp_path / "p.json"))).collect()
    assert [r.problem for r in items] == [None, "value is not a finite number", "no name"] and items[0].entity == "p1"
    ontology = spark.createDataFrame([("A", "B", None), ("C", "C", ["1"])], "code string, kind string, allowed array<string>")
    rows = spark.createDataFrame([(1, ["A", "C_@_1"], 5.0, "F"), (2, ["A_@_1"], 5.0, "F"), (3, ["C"], 5.0, "F"), (4, ["Z"], 5.0, "F"), (5, [], 5.0, "F"), (6, ["A"], -1.0, "F"), (7, ["A"], 1.0, None)], "case_id long, codes array<string>, age double, sex string")
    assert {r.case_id: r.problem for r in cases.problems(rows, ontology).collect()} == {1: None, 2: "value", 3: "value", 4: "unknown code", 5: "no codes", 6: "age", 7: "sex"}


def test_csv_and_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("a", "test", float("nan")), ("b", "train", 1.0)], "k string, split string, v double")
    sinks.write_json(frame, str(tmp_path / "j"))
    assert {r.k: r.v for r in spark.read.schema("k string, split string, v double").json(str(tmp_path / "j")).collect()} == {"a": None, "b": 1.0}
    sinks.write_split_csv(frame, str(tmp_path / "c"), "split", "k")
    back = readers.csv(spark, str(tmp_path / "c" / "split=train"), "k string, v string", ["k"])
    assert [r.k for r in back.collect()] == ["b"]


def test_empty_inputs(spark, obs):
    none = obs.where("false")
    points = temporal.snapshots(none)
    assert points.count() == 0 and features.long_block(points, none).count() == 0 and cleaning.clean(none).count() == 0
    scored = spark.createDataFrame([], "id long, entity string, label int, p double")
    assert evaluation.areas(scored).first().roc_auc is None
    assert [r.n for r in evaluation.by_size(scored.withColumn("c", F.lit(1)), F.col("c")).collect()] == [0, 0, 0, 0]


def test_ranks_over_buckets(spark):
    rows = spark.range(5000).withColumn("h", ranking.hash_order(F.col("id"))).withColumn("g", F.col("id") % 2)
    got = sorted((r.h, r["rank"]) for r in ranking.hash_ranked(rows, "h").collect())
    assert [k for _, k in got] == list(range(1, 5001))
    per = ranking.hash_ranked(rows, "h", ("g",)).groupBy("g").agg(F.max("rank").alias("m"), F.countDistinct("rank").alias("d")).collect()
    assert all(r.m == r.d == 2500 for r in per)


def test_quantiles_with_outliers_have_even_buckets(spark):
    rows = spark.range(100_000).select((F.col("id") * 0.37 + 5).alias("v"), (F.col("id") % 2).alias("g")).unionByName(spark.createDataFrame([(1e300, 0), (-1e300, 0), (None, 1)], "v double, g long"))
    ordered = sorted(r.v for r in rows.where("v is not null").collect())
    got = ranking.quantiles(rows, "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}).first()
    place = lambda q: (ordered[int(q * (len(ordered) - 1))], ordered[-(-int(q * (len(ordered) - 1) * 1000) // 1000)])
    assert (got.n, got.a, got.e) == (100_002, -1e300, 1e300) and got.b == pytest.approx(ordered[25_000] + (ordered[25_001] - ordered[25_000]) * 0.25)
    assert place(0.999)[0] <= got.d <= ordered[99_901] and got.c == pytest.approx((ordered[50_000] + ordered[50_001]) / 2)
    cuts = session.stored(rows.where("v is not null").agg(ranking.even_cuts("v").alias("cuts")))
    sizes = rows.where("v is not null").join(F.broadcast(cuts)).groupBy(ranking.bucket_of(F.col("v"), F.col("cuts")).alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
    assert max(r.n for r in sizes) <= 0.01 * 100_002 and all(x.hi < y.lo for x, y in zip(sizes, sizes[1:], strict=False))
    assert [r.n for r in ranking.quantiles(rows, "v", {"m": 0.5}, ("g",)).orderBy("g").collect()] == [50_002, 50_000]


def test_splits_do_not_leak(spark):
    rows = spark.range(1000).select(F.col("id").alias("entity"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    halves = splits.grouped(rows.unionByName(rows))
    counts = {(r.stratum, r.split): r["count"] for r in halves.groupBy("stratum", "split").count().collect()}
    assert counts == {(1, "test"): 20, (1, "train"): 80, (0, "test"): 180, (0, "train"): 720}
    assert splits.overlap(halves, "entity").count() == 0


def test_risk_bands(spark):
    got = spark.createDataFrame([(0.1,), (0.15,), (0.3,), (0.5,)], "p double").select(fusion.risk_band(F.col("p")).alias("b")).collect()
    assert [r.b for r in got] == ["LOW", "MODERATE", "HIGH", "VERY_HIGH"]


def test_urgency_sufficiency_and_safety(spark):
    people = [(1, 0.1, "LIMITED", None), (2, 0.9, "LIMITED", None), (3, 0.9, "LIMITED", "I have Chest Pain"), (4, None, "HIGH", "severe bleeding, chest pain"), (5, 0.3, "HIGH", None), (6, 0.2, "LIMITED", None), (7, None, "HIGH", None), (8, None, "HIGH", None)]
    context = spark.createDataFrame(people, "entity long, risk double, sufficiency_band string, evidence string")
    conditions = spark.createDataFrame([(1, "Flu", 0.1), (3, "Flu", 0.2), (4, "Flu", 0.2), (5, "Flu", 0.5), (6, "Unstable angina", 0.25), (7, "Sepsis", 0.6), (8, "Unstable angina", 0.24), (8, "Sepsis", 0.59)], "entity long, condition string, probability double")
    rows = fusion.urgency(context, conditions, ("Unstable angina",), ("chest pain", "severe bleeding"), ("Sepsis",)).collect()
    assert {r.entity: (r.urgency, r.reasons) for r in rows} == {
        1: ("ROUTINE_FOLLOW_UP", []), 2: ("INSUFFICIENT_INFORMATION", ["risk: high", "data: limited"]), 3: ("HIGH_PRIORITY", ["phrase: chest pain", "risk: high"]), 4: ("HIGH_PRIORITY", ["phrase: chest pain", "phrase: severe bleeding"]),
        5: ("ROUTINE_FOLLOW_UP", ["risk: elevated"]), 6: ("URGENT_EVALUATION", ["condition: Unstable angina (MEDIUM)"]), 7: ("URGENT_EVALUATION", []), 8: ("ROUTINE_FOLLOW_UP", [])}
    kinds = spark.createDataFrame([(1, 0.49993), (2, 0.9), (3, 1.0)], "entity long, score double")
    bands = fusion.sufficiency(kinds, spark.createDataFrame([(1, 5), (2, 1), (4, 7)], "entity long, n_evidence long"))
    assert {r.entity: (r.sufficiency, r.band) for r in bands.collect()} == {1: (0.7, "MODERATE"), 2: (0.66, "MODERATE"), 3: (0.6, "MODERATE"), 4: (0.4, "MODERATE")}
    marks = spark.createDataFrame([(1, "Creatinine", "HIGH", False), (1, "Albumin", "NORMAL", True), (2, "Albumin", "LOW", False)], "entity long, kind string, abnormality string, worsening boolean")
    rows = fusion.safety(marks, {"renal": ("Creatinine",), "hepatic": ("Albumin",)}, spark.createDataFrame([(1, "LIMITED")], "entity long, band string")).collect()
    assert {(r.entity, r.grp): (r.performed, r.flagged, r.limited) for r in rows} == {(1, "renal"): (True, True, True), (1, "hepatic"): (True, False, True), (2, "renal"): (False, False, False), (2, "hepatic"): (True, True, False)}


def test_contract_and_names():
    names = features.safe_names(["a b", "a-b", "c[1]"])
    assert list(names.values()) == ["a_b", "a_b_2", "c_1"]


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).columns


def test_points_stay_where_they_met_their_values(spark):
    """The wide rows of ``wide`` and ``long_block``, other columns of the points kept, without a shuffle after the join."""
    day = lambda n: dt.datetime(1990, 1, 1) + dt.timedelta(n)
    obs = spark.createDataFrame([(e, day(n), k, float(n % 7 + e), "u") for e in (1, 2) for n in (0, 1, 1, 250, 364, 365, 366, 729, 730, 731) for k in ("A", "B") if (n + e) % 3 or k == "A"], "entity long, ts timestamp_ntz, kind string, value double, unit string")
    points = spark.createDataFrame([(e, day(n), n % 2) for e in (1, 2, 3) for n in (0, 1, 364, 365, 366, 730, 1095, 1097, 4000)], "entity long, snap_ts timestamp_ntz, label int")
    plain = features.wide(points, features.long_block(points, obs), ("A", "B"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = features.wide_at(points, obs, ("A", "B"))
        assert got.columns == plain.columns and sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
        for frame in (got, features.long_block(points, obs)):
            plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert "SortMergeJoin" in plan and "Exchange" not in plan[: plan.index("SortMergeJoin")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    values = {(r.entity, r.snap_ts): r.n for r in features.long_block(points, obs).groupBy("entity", "snap_ts").agg(F.sum("n_long").alias("n")).collect()}
    days = obs.select("entity", "ts", "kind").distinct().collect()
    assert values == {k: n for r in points.collect() if (n := sum(d.entity == r.entity and 0 <= (r.snap_ts - d.ts).days <= 365 for d in days)) for k in [(r.entity, r.snap_ts)]}
