"""Queries of the rule layer and of the read side."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features, fusion, serving
from tidemark.plans.longitudinal import _DAILY, _with
from tidemark.sources import roles
from tidemark.sources.readers import table
from tidemark.sources.roles import SQL

#: Thresholds of the bound kinds: kind, low, high, very low, very high, direction of concern.
THRESHOLDS = (
    ("AF", 10_000.0, 60_000.0, 5_000.0, 80_000.0, "higher"),
    ("AO", None, 60_000.0, None, 80_000.0, "higher"),
    ("NF", 20_000.0, None, 10_000.0, None, "lower"),
    ("NO", 20_000.0, 90_000.0, 10_000.0, 95_000.0, "lower"),
    ("RF", None, None, None, None, "neutral"),
)
SAFETY = {"first": ("AF", "AO"), "second": ("NF", "NO", "RO")}
ROUTES = {"the": r"(^|[^a-z])the([^a-z]|$)", "und": r"(^|[^a-z])und([^a-z]|$)", "que": r"(^|[^a-z])que([^a-z]|$)", "question": r"\?"}


def _signals(spark, sf):
    went = features.progression(features.daily(roles.observations(spark, sf))).select("entity", "kind", "latest_value", "trend")
    table_ = spark.createDataFrame(list(THRESHOLDS), "kind string, low double, high double, very_low double, very_high double, direction string")
    return fusion.signals(went, table_)


def _sufficiency(spark, sf):
    confidence = features.history_confidence(roles.observations(spark, sf))
    evidence = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("entity")).agg(F.count("*").alias("n_evidence"))
    return fusion.sufficiency(confidence, evidence)


def signals(spark, sf):
    return _signals(spark, sf).withColumn("latest_value", F.round("latest_value", 4))


def sufficiency(spark, sf):
    return _sufficiency(spark, sf)


def safety_flags(spark, sf):
    return fusion.safety(_signals(spark, sf), SAFETY, _sufficiency(spark, sf))


def _context(spark, sf):
    """The latest order of each customer as its condition, with the risk made from its price."""
    last = serving.latest(table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_totalprice"), "o_custkey", "o_orderdate", "o_orderkey")
    risk = F.round(F.least(F.lit(1.0), F.col("o_totalprice") / 500000.0), 6)
    return last.select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("condition"), fusion.risk_band(risk, (0.2, 0.45, 0.7)).alias("risk_band"), risk.alias("risk"))


def urgency(spark, sf):
    """Priorities of each customer's finished orders as its conditions, and its segment as what it said."""
    conditions = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("condition"))
    conditions = conditions.agg(F.max(F.round(F.least(F.lit(1.0), F.col("o_totalprice") / 900000.0), 6)).alias("probability"))
    said = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("evidence"))
    context = _context(spark, sf).join(said, "entity").join(_sufficiency(spark, sf).select("entity", F.col("band").alias("sufficiency_band")), "entity")
    found = fusion.urgency(context, conditions, ("1-URGENT",), ("machin", "build", "in"), ("2-HIGH",), 3)
    return found.select("entity", "urgency", F.array_join("reasons", "|").alias("reasons"))


def recommend_rank(spark, sf):
    """Each customer's part types as candidates, scored from their quantities, discounts and taxes."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax")
    parts = table(spark, sf, "part").select("p_partkey", "p_type")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rolled = joined.groupBy(F.col("o_custkey").alias("entity"), F.col("p_type").alias("name")).agg(
        F.round(F.max("l_quantity") / 50, 4).alias("probability"), F.round(F.max("l_discount") * 10, 4).alias("relevance"), F.round(F.max("l_tax") * 10, 4).alias("trend"), F.round(F.min("l_quantity") / 50, 4).alias("risk"),
        F.round(F.min("l_discount") * 10, 4).alias("safety"), F.round(F.min("l_tax") * 10, 4).alias("sufficiency"),
    )
    return fusion.recommendations(rolled)


def _profiles(spark):
    return spark.createDataFrame([("flags", ["AF", "NF", "RF"]), ("open", ["AO", "NO", "RO", "XX"]), ("all", ["AF", "AO", "NF", "NO"])], "name string, kinds array<string>")


def clinical_relevance(spark, sf):
    """How far the signals of each customer concern three profiles of kinds."""
    return fusion.relevance(_signals(spark, sf), _profiles(spark))


def _protocols(spark, sf):
    """Kinds spelt as the rules look for them; the risk of every customer's latest order."""
    spelt = {"AF": "Hemoglobin A1c", "AO": "Glucose", "NF": "Systolic Blood Pressure", "NO": "Creatinine", "RF": "Body Mass Index", "RO": "Sodium"}
    kind = F.col("kind")
    for k, name in spelt.items():
        kind = F.when(F.col("kind") == k, name).otherwise(kind)
    context = _context(spark, sf).select("entity", "risk", F.col("risk_band").alias("band"))
    return fusion.biomarker_protocols(_signals(spark, sf).withColumn("kind", kind), context)


def biomarker_protocols(spark, sf):
    return _protocols(spark, sf)


def recommend_merged(spark, sf):
    """Conditions of the customers with a large order, their protocols, and the default for customers with neither."""
    large = table(spark, sf, "orders").where("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("entity")).agg(F.max("o_totalprice").alias("p"))
    conditions = large.select("entity", F.lit("renal function").alias("name"), F.round(F.col("p") / 600000, 4).alias("score"))
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"))
    return fusion.merged_recommendations(people, conditions, _protocols(spark, sf))


def applications(spark, sf):
    """Suppliers as applicants that other suppliers have verified or rejected; those pending."""
    s = table(spark, sf, "supplier")
    status = F.element_at(F.array(*[F.lit(x) for x in ("pending", "verified", "rejected")]), (F.col("s_suppkey") % 3 + 1).cast("int"))
    people = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 4 == 3, "patient").otherwise("doctor").alias("role"), status.alias("status"), F.when(F.col("s_suppkey") % 3 == 1, F.floor(F.col("s_suppkey") / 2)).alias("verified_by"), F.when(F.col("s_suppkey") % 3 == 2, F.floor(F.col("s_suppkey") / 3)).alias("rejected_by"), F.col("s_acctbal").alias("created"))
    return serving.applications(people, "all").unionByName(serving.applications(people, "pending"))


def admin_counts(spark, sf):
    """Nine counts over several tables, each aggregated to one row first."""
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    count = lambda cond, n: F.count(F.when(cond, 1)).alias(n)
    k = F.col("s_suppkey") % 3
    one = s.agg(F.count("*").alias("doctors"), count(k == 0, "pending"), count(k == 1, "verified"), count(k == 2, "rejected"))
    for rows, name in ((c, "patients"), (table(spark, sf, "orders"), "records"), (table(spark, sf, "lineitem"), "predictions"), (table(spark, sf, "events"), "analyses"), (table(spark, sf, "conversations"), "feedbacks")):
        one = one.join(F.broadcast(rows.agg(F.count("*").alias(name))))
    return one


#: Sections of a read view: what asks for each, and their titles.
ASKS = {"labs": r"lab|test|blood|result", "risk": r"risk|urgent|acute", "disease": r"symptom|disease|pain", "treatment": r"treat|drug|diet", "history": r"history|past|timeline"}
TITLES = {"labs": "RECENT LAB READINGS", "risk": "RISK EVALUATION", "disease": "DIFFERENTIAL", "treatment": "CARE PLAN", "history": "TIMELINE"}
#: Texts that customers are taken to send, by the last digit of their key.
MESSAGES = ("My lab results?", "What is my risk", "I have a pain", "Which diet treats it", "Tell me my history", "Hello there", "risk and history", "blood test", "acute symptoms", "")


def context_sections(spark, sf):
    """What a customer's message is answered from: a summary and the sections it asks for, each of a few lines."""
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), "c_name", "c_mktsegment")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus")
    day, key = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey")
    newest = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    line = lambda *parts: F.concat_ws(" ", *parts)
    ordered = lambda text, order, most: serving.section(orders, "entity", text, order, most)
    by_time = [-F.unix_micros(F.col("o_orderdate").cast("timestamp")), -key]
    sections = {
        "labs": ordered(line(F.lit("-"), key.cast("string"), F.col("o_orderstatus"), day), by_time, 5),
        "risk": ordered(line(F.lit("- price of"), key.cast("string")), [-F.col("o_totalprice"), key], 5),
        "disease": ordered(line(F.lit("-"), "o_orderpriority", key.cast("string")), [F.col("o_orderpriority"), key], 4),
        "treatment": ordered(line(F.lit("* item"), key.cast("string")), [F.col("o_totalprice"), key], 5),
        "history": ordered(line(F.lit("- past"), day), by_time, 3),
    }
    summary = people.select("entity", F.concat(F.lit("### SUMMARY:\n- "), "c_name", F.lit(" ("), "c_mktsegment", F.lit(")")).alias("text"))
    text = F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), (F.col("entity") % 10 + 1).cast("int"))
    requests = people.select(F.col("entity").alias("id"), "entity", text.alias("text"))
    return serving.assembled(requests, summary, sections, ASKS, ("labs", "risk", "disease", "treatment"), TITLES)


def same_text(spark, sf):
    return table(spark, sf, "customer").where(serving.same_text("c_mktsegment", "Building")).select("c_custkey", "c_mktsegment")


def latest_per_entity(spark, sf):
    return serving.latest(table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus"), "o_custkey", "o_orderdate", "o_orderkey")


def dashboard_join(spark, sf):
    people = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    last = latest_per_entity(spark, sf).select("o_custkey", F.col("o_orderkey").alias("last_order"), "o_totalprice")
    signal = _signals(spark, sf).groupBy("entity").agg(F.count(F.when(F.col("abnormality").isin("LOW", "HIGH"), 1)).alias("abnormal"), F.count(F.when(F.col("worsening"), 1)).alias("worsening"))
    joined = people.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").join(signal, F.col("c_custkey") == F.col("entity"), "left")
    high = (F.coalesce("o_totalprice", F.lit(0.0)) > 300000) & (F.coalesce("abnormal", F.lit(0)) > 1)
    return joined.select("c_custkey", "c_name", "last_order", F.coalesce("o_totalprice", F.lit(0.0)).alias("last_price"), F.coalesce("abnormal", F.lit(0)).alias("abnormal"), F.coalesce("worsening", F.lit(0)).alias("worsening"), F.when(high, "REVIEW").otherwise("OK").alias("insight"))


def history_union(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("ref"), F.col("o_orderstatus").alias("detail"))
    events = table(spark, sf, "events").select(F.col("user_id").alias("entity"), "ts", F.col("event_id").alias("ref"), F.col("event_type").alias("detail"))
    return serving.history_union({"order": orders, "event": events})


def directory_facets(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("city"), "n_regionkey")
    region = table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("region"))
    entries = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    specialty = F.element_at(F.array(*[F.lit(x) for x in ("heart", "cardiology", "skin", "bones")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    listed = entries.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "city", "region", specialty.alias("specialty"), (F.col("s_suppkey") % 5 + 1).cast("double").alias("rating"), F.col("s_acctbal").alias("price"))
    return serving.directory(listed, place="nowhere", specialty="Cardiology", synonyms={"cardiology": ("heart",)}, least_rating=2.0, most_price=9000.0, text="supplier")


def kpi_counts(spark, sf):
    o = table(spark, sf, "orders")
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    return o.agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"), count(F.col("o_orderstatus") == "F", "closed"), count(F.col("o_orderpriority") == "1-URGENT", "urgent"), count(F.col("o_totalprice") > 200000, "large"))


def left_join_counts(spark, sf):
    people = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return serving.with_counts(people, table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "n_orders")


def context_routing(spark, sf):
    return serving.routed(table(spark, sf, "conversations"), ROUTES).select("conv_id", "turn", "role", "intents")


def alerts(spark, sf):
    return serving.alerts(_signals(spark, sf))


def request_histogram(spark, sf):
    """Values of events by type in cumulative buckets, as a metrics endpoint gives them."""
    limits = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)
    return table(spark, sf, "events").groupBy("event_type").agg(*[F.count(F.when(F.col("value") <= x, 1)).alias(f"le_{str(x).replace('.', '_')}") for x in limits], F.count("*").alias("n"))


_PROG = _with("obs", _DAILY)[:-1] + """, pg AS (SELECT entity, kind, arg_max(value, ts) AS l, arg_min(value, ts) AS f FROM daily GROUP BY 1, 2), tr AS (SELECT *, CASE WHEN abs(l - f) / greatest(abs(f), abs(l), 1) < 0.02 THEN 'STABLE' WHEN l > f THEN 'INCREASING' ELSE 'DECREASING' END AS trend FROM pg),
    th AS (SELECT * FROM (VALUES ('AF', 10000, 60000, 5000, 80000, 'higher'), ('AO', NULL, 60000, NULL, 80000, 'higher'), ('NF', 20000, NULL, 10000, NULL, 'lower'), ('NO', 20000, 90000, 10000, 95000, 'lower')) v(kind, low, high, vl, vh, dir)),
    ab AS (SELECT entity, t.kind, l, trend, CASE WHEN dir IS NULL THEN 'UNKNOWN' WHEN l < low THEN 'LOW' WHEN l > high THEN 'HIGH' ELSE 'NORMAL' END AS abnormality, vl, vh, dir FROM tr t LEFT JOIN th ON th.kind = t.kind),
    sg AS (SELECT entity, kind, l AS latest_value, trend, abnormality, CASE WHEN abnormality IN ('UNKNOWN', 'NORMAL') THEN abnormality WHEN abnormality = 'HIGH' AND l >= vh THEN 'HIGH' WHEN abnormality = 'LOW' AND l <= vl THEN 'HIGH' ELSE 'MILD' END AS severity,
        coalesce((dir = 'higher' AND trend = 'INCREASING') OR (dir = 'lower' AND trend = 'DECREASING'), false) AS worsening FROM ab)"""
_SUF = f"""{SQL['obs']}, hc AS (SELECT entity, count(*) AS records, count(DISTINCT kind) AS kinds, count(DISTINCT CAST(ts AS DATE)) AS dates, date_diff('second', min(ts), max(ts)) / 86400 AS days FROM obs GROUP BY entity),
    cs AS (SELECT entity, round(greatest(0, least(1, 0.20::DOUBLE * least(records / 30, 1) + 0.20::DOUBLE * least(kinds / 10, 1) + 0.25::DOUBLE * least(dates / 5, 1) + 0.20::DOUBLE * least(days / 365, 1))), 6) AS c FROM hc),
    ev AS (SELECT o_custkey AS entity, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    su AS (SELECT entity, coalesce(n, 0) AS n_evidence, 0.6::DOUBLE * coalesce(c, 0) + 0.4::DOUBLE * CASE WHEN n IS NULL THEN 0 WHEN n < 2 THEN 0.3::DOUBLE ELSE least(1, n / 5) END AS raw FROM cs FULL JOIN ev USING (entity)),
    sb AS (SELECT entity, n_evidence, round(CAST(raw AS DECIMAL(18, 9)), 3)::DOUBLE AS sufficiency, CASE WHEN raw >= 0.70::DOUBLE THEN 'HIGH' WHEN raw >= 0.40::DOUBLE THEN 'MODERATE' ELSE 'LIMITED' END AS band FROM su)"""
_BANDS = _SUF.removeprefix(SQL["obs"] + ", ")  # where the observations stand already
_PROTOCOLS = """, sp AS (SELECT entity, kind, abnormality FROM sg), fl AS (SELECT entity, bool_or(kind = 'AF' AND abnormality IN ('HIGH', 'MILD', 'NORMAL') OR kind = 'AO' AND abnormality IN ('HIGH', 'MILD')) AS g, bool_or(kind = 'NF') AS p, bool_or(kind = 'NO') AS r, bool_or(kind = 'RF') AS w FROM sp GROUP BY entity),
    rs AS (SELECT o_custkey AS entity, round(least(1, o_totalprice / 500000), 6) AS risk FROM lt WHERE i = 1),
    pr AS (SELECT entity, 'Glycemic Dysregulation & Metabolic Management' AS name, 0.88::DOUBLE AS score FROM fl WHERE g UNION ALL SELECT entity, 'Hypertension & Cardiovascular Risk Management', 0.82 FROM fl WHERE p UNION ALL SELECT entity, 'Renal Function Monitoring & Nephroprotection', 0.78 FROM fl WHERE r
        UNION ALL SELECT entity, 'Metabolic & Weight Management Protocol', 0.72 FROM fl WHERE w
        UNION ALL SELECT entity, '90-Day Acute Risk Mitigation & Surveillance (' || CASE WHEN risk < 0.2 THEN 'LOW' WHEN risk < 0.45 THEN 'MODERATE' WHEN risk < 0.7 THEN 'HIGH' ELSE 'VERY_HIGH' END || ' Risk)', 0.80 FROM rs)"""
_NEWEST, _LINE = "ORDER BY o_orderdate DESC, o_orderkey DESC", lambda name, line, order, most: f"{name} AS (SELECT entity, string_agg(line, chr(10) ORDER BY i) AS t FROM (SELECT o_custkey AS entity, {line} AS line, row_number() OVER (PARTITION BY o_custkey {order}) AS i FROM orders) WHERE i <= {most} GROUP BY entity)"
_LAST = "lt AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM orders)"

QUERIES = {
    f.__name__: f
    for f in (
        signals, sufficiency, safety_flags, urgency, recommend_rank, latest_per_entity, dashboard_join, history_union, directory_facets, kpi_counts, left_join_counts, context_routing, alerts, request_histogram,
        clinical_relevance, biomarker_protocols, recommend_merged, applications, admin_counts, context_sections, same_text,
    )
}
ORACLES = {
    "signals": _PROG + " SELECT entity, kind, round(latest_value, 4) AS latest_value, trend, abnormality, severity, worsening FROM sg",
    "sufficiency": f"WITH {_SUF} SELECT entity, n_evidence, sufficiency, band FROM sb",
    "safety_flags": _PROG + f""", {_BANDS}, g AS (SELECT * FROM (VALUES ('first', ['AF', 'AO']), ('second', ['NF', 'NO', 'RO'])) v(grp, ks)), r AS (SELECT entity, list(kind) AS seen, list(kind) FILTER (abnormality IN ('LOW', 'HIGH')) AS bad FROM sg GROUP BY entity)
        SELECT r.entity, grp, len(list_intersect(seen, ks)) > 0 AS performed, len(list_intersect(coalesce(bad, []), ks)) > 0 AS flagged, coalesce(array_to_string(list_sort(list_intersect(coalesce(bad, []), ks)), ','), '') AS concerns, coalesce(sb.band = 'LIMITED', false) AS limited
        FROM r CROSS JOIN g LEFT JOIN sb ON sb.entity = r.entity""",
    "urgency": f"""WITH {_SUF}, {_LAST}, cx AS (SELECT o_custkey AS entity, round(least(1, o_totalprice / 500000), 6) AS risk FROM lt WHERE i = 1),
        cn AS (SELECT o_custkey AS entity, o_orderpriority AS condition, max(round(least(1, o_totalprice / 900000), 6)) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY p DESC, condition) AS i FROM cn),
        f AS (SELECT entity, bool_or((condition = '1-URGENT' AND p >= 0.25) OR (condition = '2-HIGH' AND p >= 0.6)) AS urgent, string_agg('condition: ' || condition || CASE WHEN p >= 0.6 THEN ' (HIGH)' ELSE ' (MEDIUM)' END, '|' ORDER BY i) FILTER (condition = '1-URGENT' AND p >= 0.25) AS red FROM k WHERE i <= 3 GROUP BY entity),
        t AS (SELECT cx.entity, risk, urgent, red, band, lower(c_mktsegment) AS said FROM cx JOIN customer ON c_custkey = cx.entity JOIN sb ON sb.entity = cx.entity LEFT JOIN f ON f.entity = cx.entity)
        SELECT entity, CASE WHEN band = 'LIMITED' AND urgent IS NULL THEN 'INSUFFICIENT_INFORMATION' WHEN urgent THEN 'URGENT_EVALUATION' WHEN said LIKE '%machin%' OR said LIKE '%build%' OR said LIKE '%in%' OR risk >= 0.5 THEN 'HIGH_PRIORITY' ELSE 'ROUTINE_FOLLOW_UP' END AS urgency,
            concat_ws('|', red, CASE WHEN said LIKE '%machin%' THEN 'phrase: machin' END, CASE WHEN said LIKE '%build%' THEN 'phrase: build' END, CASE WHEN said LIKE '%in%' THEN 'phrase: in' END,
                CASE WHEN risk >= 0.5 THEN 'risk: high' WHEN risk >= 0.3 THEN 'risk: elevated' END, CASE WHEN band = 'LIMITED' AND urgent IS NULL THEN 'data: limited' END) AS reasons FROM t""",
    "recommend_rank": """WITH r AS (SELECT o_custkey AS entity, p_type AS name, round(max(l_quantity) / 50, 4) AS probability, round(max(l_discount) * 10, 4) AS relevance, round(max(l_tax) * 10, 4) AS trend, round(min(l_quantity) / 50, 4) AS risk, round(min(l_discount) * 10, 4) AS safety, round(min(l_tax) * 10, 4) AS sufficiency
            FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
        s AS (SELECT *, round(probability * 0.35::DOUBLE + relevance * 0.20::DOUBLE + trend * 0.15::DOUBLE + risk * 0.15::DOUBLE - safety * 0.15::DOUBLE - 0.20::DOUBLE * (1 - sufficiency) + 3.7e-8, 4) AS score FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, name) AS rank FROM s) SELECT * FROM k WHERE rank <= 3""",
    "clinical_relevance": _PROG + """, pf AS (SELECT * FROM (VALUES ('flags', 'AF', 3), ('flags', 'NF', 3), ('flags', 'RF', 3), ('open', 'AO', 4), ('open', 'NO', 4), ('open', 'RO', 4), ('all', 'AF', 4), ('all', 'AO', 4), ('all', 'NF', 4), ('all', 'NO', 4)) v(name, kind, n))
        SELECT entity, name, round(count(DISTINCT CASE WHEN abnormality IN ('LOW', 'HIGH') THEN sg.kind END) / any_value(n), 6) AS relevance, round(least(1, sum(CASE WHEN worsening THEN CASE severity WHEN 'HIGH' THEN 1.0 WHEN 'MODERATE' THEN 0.6 WHEN 'MILD' THEN 0.3 WHEN 'NORMAL' THEN 0.0 ELSE 0.2 END ELSE 0 END)::DOUBLE / any_value(n)), 6) AS trend
        FROM sg JOIN pf ON pf.kind = sg.kind GROUP BY entity, name""",
    "biomarker_protocols": _PROG + f", {_LAST}{_PROTOCOLS} SELECT entity, name, score FROM pr",
    "recommend_merged": _PROG + f""", {_LAST}{_PROTOCOLS}, cn AS (SELECT o_custkey AS entity, 'renal function' AS name, round(max(o_totalprice) / 600000, 4) AS score FROM orders WHERE o_totalprice > 400000 GROUP BY 1),
        al AS (SELECT entity, name, score, 'condition' AS origin FROM cn UNION ALL SELECT entity, name, score, 'protocol' FROM pr WHERE NOT (name LIKE 'Renal Function%' AND entity IN (SELECT entity FROM cn))),
        ev AS (SELECT * FROM al UNION ALL SELECT c_custkey, 'Preventive Health & Longitudinal Surveillance', 0.75, 'preventive' FROM customer WHERE c_custkey NOT IN (SELECT entity FROM al))
        SELECT entity, name, score, origin, row_number() OVER (PARTITION BY entity ORDER BY score DESC, origin, name) AS rank FROM ev""",
    "applications": """WITH p AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 4 = 3 THEN 'patient' ELSE 'doctor' END AS role, ['pending', 'verified', 'rejected'][s_suppkey % 3 + 1] AS status, CASE WHEN s_suppkey % 3 = 1 THEN s_suppkey // 2 END AS v, CASE WHEN s_suppkey % 3 = 2 THEN s_suppkey // 3 END AS r, s_acctbal AS created FROM supplier),
        a AS (SELECT p.id, p.name, p.status, p.created, v.name AS verified_by_name, r.name AS rejected_by_name FROM p LEFT JOIN p v ON v.id = p.v LEFT JOIN p r ON r.id = p.r WHERE p.role = 'doctor') SELECT * FROM a UNION ALL SELECT * FROM a WHERE status = 'pending'""",
    "admin_counts": "SELECT (SELECT count(*) FROM supplier) AS doctors, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 0) AS pending, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 1) AS verified, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 2) AS rejected, (SELECT count(*) FROM customer) AS patients, (SELECT count(*) FROM orders) AS records, (SELECT count(*) FROM lineitem) AS predictions, (SELECT count(*) FROM events) AS analyses, (SELECT count(*) FROM conversations) AS feedbacks",
    "context_sections": f"""WITH {_LINE("lb", "'- ' || o_orderkey || ' ' || o_orderstatus || ' ' || strftime(o_orderdate, '%Y-%m-%d')", _NEWEST, 5)}, {_LINE("rk", "'- price of ' || o_orderkey", "ORDER BY o_totalprice DESC, o_orderkey", 5)}, {_LINE("ds", "'- ' || o_orderpriority || ' ' || o_orderkey", "ORDER BY o_orderpriority, o_orderkey", 4)},
        {_LINE("tr", "'* item ' || o_orderkey", "ORDER BY o_totalprice, o_orderkey", 5)}, {_LINE("hs", "'- past ' || strftime(o_orderdate, '%Y-%m-%d')", _NEWEST, 3)},
        n AS (SELECT c_custkey AS entity, '### SUMMARY:' || chr(10) || '- ' || c_name || ' (' || c_mktsegment || ')' AS s, [['labs'], ['risk'], ['disease'], ['treatment'], ['history'], ['labs', 'risk', 'disease', 'treatment'], ['risk', 'history'], ['labs'], ['risk', 'disease'], ['labs', 'risk', 'disease', 'treatment']][c_custkey % 10 + 1] AS w FROM customer)
        SELECT n.entity AS id, n.entity, concat_ws(chr(10), s, CASE WHEN list_contains(w, 'labs') THEN chr(10) || '### RECENT LAB READINGS:' || chr(10) || lb.t END, CASE WHEN list_contains(w, 'risk') THEN chr(10) || '### RISK EVALUATION:' || chr(10) || rk.t END, CASE WHEN list_contains(w, 'disease') THEN chr(10) || '### DIFFERENTIAL:' || chr(10) || ds.t END,
            CASE WHEN list_contains(w, 'treatment') THEN chr(10) || '### CARE PLAN:' || chr(10) || tr.t END, CASE WHEN list_contains(w, 'history') THEN chr(10) || '### TIMELINE:' || chr(10) || hs.t END) AS context
        FROM n LEFT JOIN lb USING (entity) LEFT JOIN rk USING (entity) LEFT JOIN ds USING (entity) LEFT JOIN tr USING (entity) LEFT JOIN hs USING (entity)""",
    "same_text": "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'",
    "latest_per_entity": f"WITH {_LAST} SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice, o_orderstatus FROM lt WHERE i = 1",
    "dashboard_join": _PROG + f""", {_LAST}, a AS (SELECT entity, count(*) FILTER (abnormality IN ('LOW', 'HIGH')) AS ab, count(*) FILTER (worsening) AS wo FROM sg GROUP BY entity)
        SELECT c_custkey, c_name, o_orderkey AS last_order, coalesce(o_totalprice, 0) AS last_price, coalesce(ab, 0) AS abnormal, coalesce(wo, 0) AS worsening, CASE WHEN o_totalprice > 300000 AND ab > 1 THEN 'REVIEW' ELSE 'OK' END AS insight
        FROM customer LEFT JOIN (SELECT * FROM lt WHERE i = 1) l ON l.o_custkey = c_custkey LEFT JOIN a ON a.entity = c_custkey""",
    "history_union": """WITH u AS (SELECT o_custkey AS entity, 'order' AS type, o_orderdate AS ts, o_orderkey AS ref, o_orderstatus AS detail FROM orders UNION ALL SELECT user_id, 'event', ts, event_id, event_type FROM events),
        k AS (SELECT *, row_number() OVER (PARTITION BY entity, type ORDER BY ts DESC, ref DESC) AS i FROM u) SELECT entity, type, ts, ref, detail FROM k WHERE i <= 10""",
    "directory_facets": """SELECT s_suppkey AS id, s_name AS name, n_name AS city, r_name AS region, ['heart', 'cardiology', 'skin', 'bones'][s_suppkey % 4 + 1] AS specialty, CAST(s_suppkey % 5 + 1 AS DOUBLE) AS rating, s_acctbal AS price, false AS matched_place
        FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_suppkey % 4 < 2 AND s_suppkey % 5 + 1 >= 2 AND s_acctbal <= 9000""",
    "kpi_counts": "SELECT count(*) AS orders, count(DISTINCT o_custkey) AS customers, count(*) FILTER (o_orderstatus = 'F') AS closed, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_totalprice > 200000) AS large FROM orders",
    "left_join_counts": "SELECT c_custkey, c_mktsegment, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer",
    "context_routing": "WITH m AS (SELECT conv_id, turn, role, array_to_string(list_filter([CASE WHEN regexp_matches(lower(text), '(^|[^a-z])the([^a-z]|$)') THEN 'the' END, CASE WHEN regexp_matches(lower(text), '(^|[^a-z])und([^a-z]|$)') THEN 'und' END, CASE WHEN regexp_matches(lower(text), '(^|[^a-z])que([^a-z]|$)') THEN 'que' END, CASE WHEN contains(text, '?') THEN 'question' END], lambda x: x IS NOT NULL), ',') AS i FROM conversations) SELECT conv_id, turn, role, CASE WHEN i IS NULL OR i = '' THEN 'general' ELSE i END AS intents FROM m",
    "alerts": _PROG + ", v AS (SELECT entity, kind, CASE WHEN severity = 'HIGH' THEN 'critical' WHEN abnormality IN ('LOW', 'HIGH') THEN 'warning' WHEN worsening THEN 'notice' END AS level, kind || ' ' || lower(abnormality) || ' ' || lower(trend) AS message FROM sg) SELECT * FROM v WHERE level IS NOT NULL",
    "request_histogram": "SELECT event_type, " + ", ".join(f"count(*) FILTER (value <= {x}) AS le_{str(x).replace('.', '_')}" for x in (1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)) + ", count(*) AS n FROM events GROUP BY event_type",
}
