"""Queries on measurements along time: cleaning, audits, snapshots, labels, features, trajectories, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import cleaning, features, temporal, trajectory
from tidemark.operators.ranking import hash_order, hash_ranked
from tidemark.sources import roles
from tidemark.sources.readers import literal_list, table
from tidemark.sources.roles import ACUTE, KINDS, SQL

#: How each kind is judged by the trajectory queries.
CONCERNS = {
    "AF": trajectory.Concern("higher", 500.0),
    "AO": trajectory.Concern("higher", 500.0),
    "NF": trajectory.Concern("lower", 500.0),
    "NO": trajectory.Concern("lower", 500.0),
    "RF": trajectory.Concern("neutral", 500.0),
    "RO": trajectory.Concern("lower", 500.0),
}


def _points(spark, sf):
    return temporal.snapshots(roles.observations(spark, sf))


def _acute(spark, sf):
    return roles.encounters(spark, sf).where(F.col("class").isin(*ACUTE))


def clean_coerce(spark, sf):
    props = table(spark, sf, "events").select(F.col("user_id").alias("entity"), F.col("ts").cast("string").alias("ts"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("value"), F.lit(None).cast("string").alias("unit"))
    return cleaning.coerced(props).groupBy("kind").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def clean_mean_by_ts(spark, sf):
    """Units in two spellings that differ in blanks: repeats in one spelling count once, in both they count each."""
    spelt = roles.observations(spark, sf).withColumn("unit", F.when(F.dayofmonth("ts") % 3 == 0, F.concat("unit", F.lit(" "))).otherwise(F.col("unit")))
    twice = spelt.unionByName(spelt.where(F.dayofmonth("ts") % 5 == 0).withColumn("unit", F.trim("unit")))
    return cleaning.clean(twice, KINDS[:5]).withColumn("value", F.round("value", 4))


def audit_exact_dups(spark, sf):
    return cleaning.repeated_rows(roles.observations(spark, sf).select("entity", "kind", F.round(F.col("value") / 1000).alias("value")), ("entity", "kind", "value"))


def audit_repeat_groups(spark, sf):
    return cleaning.repeated_rows(roles.observations(spark, sf), ("entity", "ts", "kind"))


def audit_units(spark, sf):
    return cleaning.unit_mix(roles.observations(spark, sf))


def audit_quantiles(spark, sf):
    return cleaning.spread(roles.observations(spark, sf))


def audit_repeat_rows(spark, sf):
    """The rows of repeated groups, with the size of their group."""
    return cleaning.repeated_members(roles.observations(spark, sf), ("entity", "ts", "kind")).select("entity", "ts", "kind", F.round("value", 4).alias("value"), "copies")


def audit_history(spark, sf):
    return cleaning.history(roles.observations(spark, sf))


def audit_history_summary(spark, sf):
    return cleaning.described(cleaning.history(roles.observations(spark, sf)), "days")


def audit_kind_coverage(spark, sf):
    return cleaning.history(roles.observations(spark, sf)).groupBy("n_kinds").agg(F.count("*").alias("entities"))


def audit_label_boundary(spark, sf):
    return cleaning.boundary(roles.encounters(spark, sf))


def snapshots_90d(spark, sf):
    return _points(spark, sf)


def snapshots_cutoff(spark, sf):
    cutoff = cleaning.boundary(roles.encounters(spark, sf)).select("safe_cutoff")
    return temporal.snapshots(roles.observations(spark, sf), cutoff=cutoff).where("snap_ts >= timestamp_ntz'1997-01-01'")


def label_forward_90d(spark, sf):
    return temporal.forward_labels(_points(spark, sf), _acute(spark, sf)).select("entity", "snap_ts", "history_days", "n_kinds", "label", "first_event")


def label_balance(spark, sf):
    labelled = temporal.forward_labels(_points(spark, sf), _acute(spark, sf))
    return labelled.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("entities"))


def _event_windows(spark, sf):
    """The feature block on the event stream's values: windows of 7 and 3 days, points each 7 days."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("entity"), "ts", F.col("event_type").alias("kind"), "value")
    points = temporal.snapshots(events, every=7, least_history=7)
    return features.long_block(points, events, "serve", 7, 3)


#: Added before rounding, so that a value half-way between two rounded ones falls on the same side in any engine.
NUDGE = 3.7e-7


def _rounded(frame, places=3):
    """Doubles to whole thousandths by binary arithmetic, as decimals are slow; ``+ 0.0`` makes -0.0 plain."""
    whole = lambda c: F.rint((F.col(c) + NUDGE) * 10.0**places) / 10.0**places + 0.0
    return frame.select(*[whole(c).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])


def features_long_train(spark, sf):
    return _rounded(features.long_block(_points(spark, sf), roles.observations(spark, sf), "train"))


def features_long_serve(spark, sf):
    return _rounded(_event_windows(spark, sf))


def features_wide(spark, sf):
    out = features.wide_at(_points(spark, sf).select("entity", "snap_ts"), roles.observations(spark, sf), KINDS)
    features.check_contract(out, features.feature_names(KINDS))
    return _rounded(out)


def feature_coverage(spark, sf):
    names = [n for n in features.feature_names(KINDS) if not n.endswith("__missing")]
    return features.coverage(features.wide_at(_points(spark, sf).select("entity", "snap_ts"), roles.observations(spark, sf), KINDS), names)


def trajectory_kind(spark, sf):
    return _rounded(trajectory.by_kind(features.daily(roles.observations(spark, sf)), CONCERNS))


def trajectory_overall(spark, sf):
    return trajectory.overall(trajectory.by_kind(features.daily(roles.observations(spark, sf)), CONCERNS))


def progression(spark, sf):
    return _rounded(features.progression(features.daily(roles.observations(spark, sf))))


def history_confidence(spark, sf):
    return features.history_confidence(roles.observations(spark, sf))


def risk_progression_expanding(spark, sf):
    """At every date of an entity: values and mean over the year before, and the band of a score made from them."""
    from tidemark.operators.fusion import risk_band

    obs = features.daily(roles.observations(spark, sf))
    points = obs.select("entity", F.col("ts").alias("snap_ts")).distinct()
    met = temporal.range_join(points, obs, 365, 0).groupBy("entity", "snap_ts").agg(F.count("*").alias("n"), F.round(F.avg("value") + NUDGE, 3).alias("mean"))
    p = F.round(F.least(F.lit(1.0), F.col("n") / 40.0), 6)
    return met.select("entity", "snap_ts", "n", "mean", p.alias("p"), risk_band(p).alias("band"))


def _labelled(spark, sf):
    return temporal.forward_labels(_points(spark, sf), _acute(spark, sf)).select("entity", "snap_ts", "label")


def _quota(labelled):
    """Negatives with the quota of their entity: three for each positive (3 to 12), or 3 where it has none."""
    positives = labelled.groupBy("entity").agg(F.sum("label").alias("_pos"))
    quota = F.when(F.col("_pos") > 0, F.least(F.greatest(F.lit(3), 3 * F.col("_pos")), F.lit(12))).otherwise(3)
    return labelled.where("label = 0").join(positives, "entity").withColumn("quota", quota.cast("int")).drop("_pos")


def neg_sample_spaced(spark, sf):
    return temporal.spaced(_quota(_labelled(spark, sf)), F.col("quota")).select("entity", "snap_ts")


def neg_sample_capped(spark, sf):
    """Of the spaced negatives the 3,000 first by hash: a cap is what this operator is for."""
    chosen = temporal.spaced(_quota(_labelled(spark, sf)), F.col("quota")).select("entity", "snap_ts")
    keyed = chosen.withColumn("_h", hash_order(F.col("entity"), F.date_format("snap_ts", "yyyy-MM-dd HH:mm:ss")))
    return hash_ranked(keyed, "_h").where("rank <= 3000").select("entity", "snap_ts")


def training_rows(spark, sf):
    """All positives and the spaced negatives, with their origin."""
    labelled = _labelled(spark, sf)
    negatives = temporal.spaced(_quota(labelled), F.col("quota")).select("entity", "snap_ts", "label")
    return labelled.where("label = 1").unionByName(negatives)


def literal_parse(spark, sf):
    props = table(spark, sf, "events").select("event_id", F.concat(F.lit("['"), "event_type", F.lit("', 'u"), F.col("user_id").cast("string"), F.lit("']")).alias("raw"))
    return props.select("event_id", literal_list(F.col("raw")).alias("l")).select("event_id", F.col("l")[0].alias("first"), F.col("l")[1].alias("second"), F.size("l").alias("n"))


_SNAP = """span AS (SELECT entity, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows, count(DISTINCT kind) AS n_kinds FROM obs GROUP BY entity),
snap AS (SELECT entity, unnest(generate_series(first_ts + INTERVAL 90 DAY, last_ts, INTERVAL 90 DAY)) AS snap_ts, first_ts, last_ts, n_rows, n_kinds FROM span)"""
_ACUTE = "acute AS (SELECT entity, ts FROM enc WHERE class IN ('1-urgent', '2-high'))"
_LAB = "lab AS (SELECT s.entity, s.snap_ts, any_value(s.n_kinds) AS n_kinds, any_value(s.first_ts) AS first_ts, min(a.ts) AS first_event, CASE WHEN min(a.ts) IS NULL THEN 0 ELSE 1 END AS label FROM snap s LEFT JOIN acute a ON a.entity = s.entity AND a.ts > s.snap_ts AND a.ts <= s.snap_ts + INTERVAL 90 DAY GROUP BY s.entity, s.snap_ts)"
_DAILY = "daily AS (SELECT entity, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, kind, median(value) AS value FROM obs GROUP BY ALL)"
_SLOPE = "CASE WHEN isnan({0}) THEN NULL ELSE {0} END"
_BLOCK = f"""j AS (SELECT s.entity, s.snap_ts, d.kind, d.ts, d.value, date_diff('day', s.snap_ts, d.ts)::DOUBLE AS x FROM (SELECT DISTINCT entity, CAST(date_trunc('day', snap_ts) AS TIMESTAMP) AS snap_ts FROM snap) s
    JOIN daily d ON d.entity = s.entity AND d.ts >= s.snap_ts - INTERVAL 365 DAY AND d.ts <= s.snap_ts),
block AS (SELECT entity, snap_ts, kind, count(*) AS n_long, arg_max(value, ts) AS latest, avg(value) AS mean_long, min(value) AS min_long, max(value) AS max_long, stddev_pop(value) AS std_long,
    avg(value) FILTER (ts >= snap_ts - INTERVAL 90 DAY) AS mean_short, {_SLOPE.format("regr_slope(value, x)")} AS slope_long,
    {_SLOPE.format("regr_slope(value, x) FILTER (ts >= snap_ts - INTERVAL 90 DAY)")} AS slope_short,
    CASE WHEN count(*) > 1 THEN arg_max(value, ts) - arg_min(value, ts) END AS abs_change,
    CASE WHEN count(*) > 1 AND abs(arg_min(value, ts)) >= 1e-12 THEN (arg_max(value, ts) - arg_min(value, ts)) / abs(arg_min(value, ts)) END AS rel_change,
    date_diff('day', max(ts), snap_ts)::DOUBLE AS days_since FROM j GROUP BY entity, snap_ts, kind)"""
_STATS = [s for s in features.STATISTICS if s != "missing"]
_TRAJ = f"""ends AS (SELECT entity, max(ts) AS ref FROM daily GROUP BY entity),
t AS (SELECT d.entity, d.kind, arg_min(value, ts) AS f, arg_max(value, ts) AS l, count(*) AS points, date_diff('day', min(ts), max(ts)) AS span,
    {_SLOPE.format("regr_slope(value, date_diff('day', ref, ts)::DOUBLE)")} AS slope FROM daily d JOIN ends e ON e.entity = d.entity WHERE ts >= ref - INTERVAL 730 DAY GROUP BY d.entity, d.kind),
c AS (SELECT * FROM (VALUES ('AF', 'higher'), ('AO', 'higher'), ('NF', 'lower'), ('NO', 'lower'), ('RF', 'neutral'), ('RO', 'lower')) v(kind, direction)),
kinds AS (SELECT t.entity, t.kind, f AS first_value, l AS latest_value, l - f AS absolute_change, CASE WHEN abs(f) >= 1e-12 THEN (l - f) / abs(f) END AS relative_change, slope AS slope_per_day, span AS days_covered, points,
    CASE WHEN points < 2 OR span <= 0 THEN 'LOW' WHEN points >= 3 AND span >= 90 THEN 'HIGH' WHEN span >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
    CASE WHEN points < 2 OR span <= 0 THEN 'INSUFFICIENT_HISTORY' WHEN abs(l - f) < 500 OR abs((l - f) / abs(f)) < 0.03 THEN 'STABLE' WHEN direction = 'neutral' THEN 'CHANGING_NEUTRAL'
         WHEN (direction = 'higher') = (l > f) THEN 'WORSENING' ELSE 'IMPROVING' END AS status FROM t JOIN c USING (kind))"""
_SPACED = f"""q AS (SELECT entity, CASE WHEN sum(label) > 0 THEN least(greatest(3, 3 * sum(label)), 12) ELSE 3 END AS k FROM lab GROUP BY entity),
neg AS (SELECT l.entity, l.snap_ts, k, row_number() OVER (PARTITION BY l.entity ORDER BY l.snap_ts) - 1 AS i, count(*) OVER (PARTITION BY l.entity) AS n FROM lab l JOIN q ON q.entity = l.entity WHERE label = 0),
spaced AS (SELECT entity, snap_ts FROM neg WHERE k >= n OR i IN (SELECT round_even(m * (n - 1) / (k - 1), 0) FROM range(0, k::BIGINT) r(m)))"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(SQL.get(p, p) for p in parts) + " "


def _r(columns, places=3):
    return ", ".join(f"round({c} + {NUDGE}, {places}) AS {c}" for c in columns)


_LABELLED = _with("obs", "enc", _SNAP, _ACUTE, _LAB)
_FEATURES = _with("obs", _SNAP, _DAILY, _BLOCK)
_WIDE = ", ".join(
    f"CASE WHEN max(latest) FILTER (kind = '{k}') IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"{k}__missing\"" if s == "missing" else f"round(max({s}) FILTER (kind = '{k}') + {NUDGE}, 3) AS \"{k}__{s}\"" for k in KINDS for s in features.STATISTICS
)
_FILLED = " + ".join(f"count({s}) FILTER (kind = '{k}')" for k in KINDS for s in _STATS)

QUERIES = {
    f.__name__: f
    for f in (
        clean_coerce, clean_mean_by_ts, audit_exact_dups, audit_repeat_groups, audit_repeat_rows, audit_units, audit_quantiles, audit_history, audit_history_summary, audit_kind_coverage, audit_label_boundary,
        snapshots_90d, snapshots_cutoff, label_forward_90d, label_balance, features_long_train, features_long_serve, features_wide, feature_coverage, trajectory_kind, trajectory_overall,
        progression, history_confidence, risk_progression_expanding, neg_sample_spaced, neg_sample_capped, training_rows, literal_parse,
    )
}
ORACLES = {
    "clean_coerce": "SELECT event_type AS kind, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS total FROM events WHERE try_cast(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL GROUP BY 1",
    "clean_mean_by_ts": _with("obs") + """, sp AS (SELECT entity, ts, kind, value, CASE WHEN day(ts) % 3 = 0 THEN unit || ' ' ELSE unit END AS unit FROM obs), tw AS (SELECT * FROM sp UNION ALL SELECT entity, ts, kind, value, trim(unit) FROM sp WHERE day(ts) % 5 = 0),
        d AS (SELECT DISTINCT entity, ts, kind, value, unit FROM tw WHERE kind IN ('AF', 'AO', 'NF', 'NO', 'RF')) SELECT entity, ts, kind, trim(coalesce(unit, '')) AS unit, round(avg(value), 4) AS value, count(*) AS n_raw FROM d GROUP BY entity, ts, kind, trim(coalesce(unit, ''))""",
    "audit_exact_dups": _with("obs") + "SELECT entity, kind, round(value / 1000) AS value, count(*) AS copies FROM obs GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "audit_repeat_rows": _with("obs") + "SELECT entity, ts, kind, round(value, 4) AS value, copies FROM (SELECT *, count(*) OVER (PARTITION BY entity, ts, kind) AS copies FROM obs) WHERE copies > 1",
    "audit_repeat_groups": _with("obs") + "SELECT entity, ts, kind, count(*) AS copies FROM obs GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "audit_units": _with("obs") + """, u AS (SELECT kind, unit, count(*) AS n FROM obs GROUP BY kind, unit), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, unit) AS i FROM u)
        SELECT kind, sum(n) AS n_rows, coalesce(sum(n) FILTER (unit IS NULL), 0) AS n_without, count(unit) AS n_units, max(unit) FILTER (i = 1) AS top_unit, round(max(n) FILTER (i = 1) / sum(n), 6) AS top_share FROM k GROUP BY kind""",
    "audit_quantiles": _with("obs") + "SELECT kind, count(value) AS n, min(value) AS least, max(value) AS most, " + ", ".join(f"round(quantile_cont(value, {q}), 4) AS p{n}" for q, n in ((0.01, "01"), (0.05, "05"), (0.5, "50"), (0.95, "95"), (0.99, "99"))) + " FROM obs GROUP BY kind",
    "audit_history": _with("obs") + "SELECT entity, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows, count(DISTINCT kind) AS n_kinds, date_diff('day', min(ts), max(ts)) AS days FROM obs GROUP BY entity",
    "audit_history_summary": _with("obs") + ", h AS (SELECT date_diff('day', min(ts), max(ts)) AS days FROM obs GROUP BY entity) SELECT count(days) AS n, round(avg(days), 4) AS mean, round(stddev_samp(days), 4) AS std, min(days) AS least, max(days) AS most, round(quantile_cont(days, 0.25), 4) AS p25, round(quantile_cont(days, 0.5), 4) AS p50, round(quantile_cont(days, 0.75), 4) AS p75 FROM h",
    "audit_kind_coverage": _with("obs") + ", h AS (SELECT count(DISTINCT kind) AS n_kinds FROM obs GROUP BY entity) SELECT n_kinds, count(*) AS entities FROM h GROUP BY n_kinds",
    "audit_label_boundary": _with("enc") + "SELECT max(ts) AS last_event, max(ts) - INTERVAL 90 DAY AS safe_cutoff FROM enc",
    "snapshots_90d": _with("obs", _SNAP) + "SELECT entity, snap_ts, first_ts, last_ts, n_rows, n_kinds, date_diff('day', first_ts, snap_ts) AS history_days FROM snap",
    "snapshots_cutoff": _with("obs", "enc", _SNAP) + "SELECT entity, snap_ts, first_ts, last_ts, n_rows, n_kinds, date_diff('day', first_ts, snap_ts) AS history_days FROM snap WHERE snap_ts <= (SELECT max(ts) - INTERVAL 90 DAY FROM enc) AND snap_ts >= TIMESTAMP '1997-01-01'",
    "label_forward_90d": _LABELLED + "SELECT entity, snap_ts, date_diff('day', first_ts, snap_ts) AS history_days, n_kinds, label, first_event FROM lab",
    "label_balance": _LABELLED + "SELECT label, count(*) AS n, count(DISTINCT entity) AS entities FROM lab GROUP BY label",
    "features_long_train": _FEATURES + f"SELECT entity, snap_ts, kind, n_long, {_r(_STATS)} FROM block",
    "features_long_serve": f"""WITH obs AS (SELECT user_id AS entity, ts, event_type AS kind, value FROM events),
        span AS (SELECT entity, min(ts) AS f, max(ts) AS l FROM obs GROUP BY entity), snap AS (SELECT entity, unnest(generate_series(f + INTERVAL 7 DAY, l, INTERVAL 7 DAY)) AS snap_ts FROM span),
        hist AS (SELECT s.entity, s.snap_ts, o.kind, arg_max(value, {{'t': ts, 'v': value}}) AS latest, greatest(0.0, ((epoch_us(s.snap_ts) - epoch_us(max(ts))) // 1000000) / 86400)::DOUBLE AS days_since FROM snap s JOIN obs o ON o.entity = s.entity AND o.ts <= s.snap_ts GROUP BY s.entity, s.snap_ts, o.kind),
        j AS (SELECT s.entity, s.snap_ts, o.kind, o.ts, o.value, date_diff('day', s.snap_ts, o.ts)::DOUBLE AS x FROM snap s JOIN obs o ON o.entity = s.entity AND o.ts >= s.snap_ts - INTERVAL 7 DAY AND o.ts <= s.snap_ts),
        block AS (SELECT entity, snap_ts, kind, count(*) AS n_long, avg(value) AS mean_long, min(value) AS min_long, max(value) AS max_long, stddev_samp(value) AS std_long, avg(value) FILTER (ts >= snap_ts - INTERVAL 3 DAY) AS mean_short,
            {_SLOPE.format("regr_slope(value, x)")} AS slope_long, {_SLOPE.format("regr_slope(value, x) FILTER (ts >= snap_ts - INTERVAL 3 DAY)")} AS slope_short,
            arg_max(value, {{'t': ts, 'v': value}}) - arg_min(value, {{'t': ts, 'v': value}}) AS abs_change,
            CASE WHEN abs(arg_min(value, {{'t': ts, 'v': value}})) >= 1e-12 THEN (arg_max(value, {{'t': ts, 'v': value}}) - arg_min(value, {{'t': ts, 'v': value}})) / abs(arg_min(value, {{'t': ts, 'v': value}})) END AS rel_change FROM j GROUP BY entity, snap_ts, kind)
        SELECT entity, snap_ts, kind, coalesce(n_long, 0) AS n_long, {_r(_STATS)} FROM hist LEFT JOIN block USING (entity, snap_ts, kind)""",
    "features_wide": _FEATURES + f"SELECT s.entity, s.snap_ts, {_WIDE} FROM snap s LEFT JOIN block b ON b.entity = s.entity AND b.snap_ts = s.snap_ts GROUP BY s.entity, s.snap_ts",
    "feature_coverage": _FEATURES + f"SELECT s.entity, s.snap_ts, {6 * 11} AS n_features, {_FILLED} AS n_filled, round(({_FILLED}) / {6 * 11}, 6) AS coverage FROM snap s LEFT JOIN block b ON b.entity = s.entity AND b.snap_ts = s.snap_ts GROUP BY s.entity, s.snap_ts",
    "trajectory_kind": _with("obs", _DAILY, _TRAJ) + f"SELECT entity, kind, {_r(('first_value', 'latest_value', 'absolute_change', 'relative_change', 'slope_per_day'))}, days_covered, points, confidence, status FROM kinds",
    "trajectory_overall": _with("obs", _DAILY, _TRAJ) + """, u AS (SELECT entity, status IN ('WORSENING', 'IMPROVING', 'STABLE') AS ok, status, confidence, CASE confidence WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.7 ELSE 0.4 END::DOUBLE AS w FROM kinds),
        o AS (SELECT entity, count(*) FILTER (ok) AS signals, count(*) FILTER (status = 'WORSENING') AS wo, count(*) FILTER (status = 'IMPROVING') AS im, count(*) FILTER (status = 'STABLE') AS st, count(*) FILTER (status = 'CHANGING_NEUTRAL') AS ne,
            count(*) FILTER (ok AND confidence = 'HIGH') AS high, round(sum(CASE status WHEN 'WORSENING' THEN w WHEN 'IMPROVING' THEN -w ELSE 0 END) FILTER (ok) / sum(w) FILTER (ok), 6) AS score FROM u GROUP BY entity)
        SELECT entity, CASE WHEN signals < 2 THEN 'INSUFFICIENT_DATA' WHEN score >= 0.25 THEN 'WORSENING' WHEN score <= -0.25 THEN 'IMPROVING' ELSE 'STABLE' END AS status,
            CASE WHEN signals < 2 THEN 'LOW' WHEN signals >= 5 AND high >= 3 THEN 'HIGH' WHEN signals >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, signals,
            CASE WHEN signals < 2 THEN 0 ELSE wo END AS worsening, CASE WHEN signals < 2 THEN 0 ELSE im END AS improving, CASE WHEN signals < 2 THEN 0 ELSE st END AS stable, CASE WHEN signals < 2 THEN 0 ELSE ne END AS neutral,
            CASE WHEN signals >= 2 THEN round(score, 3) END AS score FROM o""",
    "progression": _with("obs", _DAILY) + f""", ends AS (SELECT entity, max(ts) AS ref FROM daily GROUP BY entity),
        p AS (SELECT d.entity, d.kind, count(*) AS records, min(ts) AS first_ts, max(ts) AS latest_ts, arg_min(value, ts) AS first_value, arg_max(value, ts) AS latest_value, min(value) AS minimum, max(value) AS maximum, avg(value) AS mean, stddev_samp(value) AS std,
            {_SLOPE.format("regr_slope(value, date_diff('day', ref, ts)::DOUBLE)")} AS slope_per_day, count(*) FILTER (ts >= ref - INTERVAL 90 DAY) AS records_short, count(*) FILTER (ts >= ref - INTERVAL 365 DAY) AS records_long, min(ref) AS ref FROM daily d JOIN ends e ON e.entity = d.entity GROUP BY d.entity, d.kind)
        SELECT entity, kind, records, first_ts, latest_ts, {_r(('first_value', 'latest_value', 'minimum', 'maximum', 'mean', 'std', 'slope_per_day'))}, records_short, records_long,
            round(latest_value - first_value + 3.7e-7, 3) AS absolute_change, round((latest_value - first_value) / abs(first_value) * 100 + 3.7e-7, 3) AS percent_change,
            CASE WHEN abs(latest_value - first_value) / greatest(abs(first_value), abs(latest_value), 1) < 0.02 THEN 'STABLE' WHEN latest_value > first_value THEN 'INCREASING' ELSE 'DECREASING' END AS trend,
            date_diff('day', first_ts, latest_ts)::DOUBLE AS history_days, date_diff('day', latest_ts, ref)::DOUBLE AS days_since_latest FROM p""",
    "history_confidence": _with("obs") + """, h AS (SELECT entity, count(*) AS records, count(DISTINCT kind) AS kinds, count(DISTINCT CAST(ts AS DATE)) AS dates, date_diff('second', min(ts), max(ts)) / 86400 AS days FROM obs GROUP BY entity),
        s AS (SELECT *, round(greatest(0, least(1, 0.20::DOUBLE * least(records / 30, 1) + 0.20::DOUBLE * least(kinds / 10, 1) + 0.25::DOUBLE * least(dates / 5, 1) + 0.20::DOUBLE * least(days / 365, 1))), 6) AS score FROM h)
        SELECT entity, records, kinds, dates, score, CASE WHEN score >= 0.80 THEN 'HIGH' WHEN score >= 0.55 THEN 'MODERATE' ELSE 'LIMITED' END AS band FROM s""",
    "risk_progression_expanding": _with("obs", _DAILY) + """, pts AS (SELECT DISTINCT entity, ts AS snap_ts FROM daily), m AS (SELECT p.entity, p.snap_ts, count(*) AS n, round(avg(value) + 3.7e-7, 3) AS mean FROM pts p JOIN daily d ON d.entity = p.entity AND d.ts >= p.snap_ts - INTERVAL 365 DAY AND d.ts <= p.snap_ts GROUP BY p.entity, p.snap_ts)
        SELECT entity, snap_ts, n, mean, round(least(1, n / 40), 6) AS p, CASE WHEN n / 40 < 0.15 THEN 'LOW' WHEN n / 40 < 0.30 THEN 'MODERATE' WHEN n / 40 < 0.50 THEN 'HIGH' ELSE 'VERY_HIGH' END AS band FROM m""",
    "neg_sample_spaced": _LABELLED[:-1] + f", {_SPACED} SELECT entity, snap_ts FROM spaced",
    "neg_sample_capped": _LABELLED[:-1] + f", {_SPACED} SELECT entity, snap_ts FROM spaced ORDER BY md5(entity || '|' || strftime(snap_ts, '%Y-%m-%d %H:%M:%S') || '|42') LIMIT 3000",
    "training_rows": _LABELLED[:-1] + f", {_SPACED} SELECT entity, snap_ts, 1 AS label FROM lab WHERE label = 1 UNION ALL SELECT entity, snap_ts, 0 FROM spaced",
    "literal_parse": "SELECT event_id, event_type AS first, 'u' || user_id AS second, 2 AS n FROM events",
}
