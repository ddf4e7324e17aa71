"""Queries that write tables in another form and read them back: CSV, JSON records, Parquet by parts, and fields with fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import cleaning, contracts, lookups
from tidemark.session import shared_folder
from tidemark.sources import readers, sinks
from tidemark.sources.readers import table


def csv_scan(spark, sf):
    """Measurements written as CSV text and read by the declared schema: two columns of eight, then typed."""
    orders = table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    value = F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    columns = [c.split()[0] for c in readers.OBSERVATION_CSV.split(", ")]
    held = {"DATE": day, "PATIENT": F.col("o_custkey").cast("string"), "DESCRIPTION": F.col("o_orderpriority"), "VALUE": value, "UNITS": F.lit(" usd "), "CODE": F.col("o_orderkey").cast("string")}
    folder = shared_folder(spark)
    sinks.write_csv(orders.select(*[held.get(c, F.lit(None).cast("string")).alias(c) for c in columns]), f"{folder}.csv")
    raw = readers.csv_found(spark, folder, readers.OBSERVATION_CSV, ["PATIENT", "DATE", "DESCRIPTION", "VALUE", "UNITS"])
    typed = cleaning.coerced(raw.toDF("entity", "ts", "kind", "value", "unit"))
    return typed.groupBy("entity", "kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max("ts").alias("last_ts"))


def csv_splits(spark, sf):
    """Cases written as CSV by split, each file in the order of its hash, and how many came back."""
    from tidemark.operators import splits
    from tidemark.sources import roles

    bags = roles.bags(spark, sf).select("case_id", splits.signature(F.col("codes")).alias("signature"), F.concat_ws(" ", "codes").alias("codes"))
    folder = shared_folder(spark)
    sinks.write_split_csv(bags.withColumn("split", splits.split_of(splits.bucket(F.col("signature")))), folder, "split", "signature")
    back = spark.read.schema("case_id long, signature string, codes string, split string").option("header", True).csv(folder)
    return back.groupBy("split").agg(F.count("*").alias("n"), F.sum("case_id").alias("ids"), F.count_distinct("signature").alias("signatures"))


def json_records(spark, sf):
    """Entities with embedded measurements written as JSON under several names, read by fallbacks; what is wrong with each item."""
    orders = table(spark, sf, "orders")
    value = F.when(F.col("o_orderkey") % 7 == 0, "x").when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.col("o_totalprice").cast("string"))
    day = F.when(F.col("o_orderkey") % 13 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    odd = F.col("o_orderkey") % 2 == 1
    item = F.struct(F.when(odd, F.col("o_orderpriority")).alias("name"), F.when(~odd, F.col("o_orderpriority")).alias("observation"), value.alias("value"), F.when(odd, day).alias("date"), F.when(~odd, day).alias("timestamp"))
    people = orders.groupBy("o_custkey").agg(F.collect_list(item).alias("observations"))  # the records of one entity
    key = F.col("o_custkey").cast("string")
    records = people.select(F.when(F.col("o_custkey") % 2 == 0, key).alias("patient_id"), F.when(F.col("o_custkey") % 2 == 1, key).alias("id"), "observations")
    folder = shared_folder(spark)
    sinks.write_json(records, folder)
    items = readers.measurement_items(readers.records(spark, folder, lines=True))
    return items.groupBy(F.col("entity").cast("long").alias("entity"), F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("total"), F.max("ts").alias("last_ts"))


def json_finite(spark, sf):
    """Numbers that JSON lacks, at the top and inside a struct and an array, come back as nulls."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("v"))
    deep = rows.select("o_orderkey", "v", F.struct(F.when(F.col("o_orderkey") % 3 == 0, float("inf")).otherwise(F.lit(1.5)).alias("x")).alias("s"), F.array(F.col("v"), F.lit(2.0)).alias("a"))
    folder = shared_folder(spark)
    sinks.write_json(deep, folder)
    back = spark.read.schema("o_orderkey long, v double, s struct<x:double>, a array<double>").json(folder)
    return back.select("o_orderkey", "v", F.col("s.x").alias("x"), F.col("a")[0].alias("a0"), F.col("a")[1].alias("a1"))


def parquet_parts(spark, sf):
    """Orders written by status and read with one status alone: the folders of others are not opened."""
    folder = shared_folder(spark)
    sinks.write_parquet(table(spark, sf, "orders"), folder, ["o_orderstatus"])
    return spark.read.parquet(folder).where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", "o_orderstatus")


def profile_normalise(spark, sf):
    """Spellings of gender and e-mail addresses in one form."""
    c = table(spark, sf, "customer")
    gender = F.element_at(F.array(*[F.lit(x) for x in (" M", "Female", "woman", "man ", "", "n/a")]), (F.col("c_custkey") % 6 + 1).cast("int"))
    email = F.when(F.col("c_custkey") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit("@Example.ORG ")))
    return lookups.profile(c.select("c_custkey", gender.alias("gender"), email.alias("email")))


def last_json_lines(spark, sf):
    """The answer of a tool that prints other lines before it, and ages in whole years."""
    o = table(spark, sf, "orders")
    said = F.concat(F.lit("loading {x}\n{\"n\": 0}\n"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("{\"n\": "), F.col("o_orderkey").cast("string"), F.lit("}"))), F.lit("\ndone"))
    age = readers.age_in_years(F.date_sub("o_orderdate", (F.col("o_orderkey") % 30000).cast("int")), F.col("o_orderdate"))
    return o.select("o_orderkey", F.get_json_object(readers.last_json_line(said), "$.n").cast("long").alias("n"), age.alias("age"))


RULES = {"priced": lambda: F.col("o_totalprice") > 20000, "known_status": lambda: F.col("o_orderstatus").isin("F", "O", "P"), "not_urgent_open": lambda: ~((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O"))}


def contract_counts(spark, sf):
    """Orders that break a rule set apart in one pass, by rule, and the good ones."""
    good, bad, _ = contracts.set_apart(table(spark, sf, "orders"), {name: rule() for name, rule in RULES.items()})
    keys = lambda rows, problem: rows.select(problem.alias("problem"), "o_orderkey")
    both = keys(good, F.lit("none")).unionByName(keys(bad, F.col("problem")))
    return both.groupBy("problem").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


def literal_errors(spark, sf):
    """Fields of single-quoted literals made from events, some of them broken, by kind of error."""
    which = F.col("event_id") % 6
    said = F.concat(F.lit("{'kind': '"), "event_type", F.lit("', 'user': "), F.col("user_id").cast("string"), F.lit(", 'ok': True}"))
    raw = F.when(which == 0, F.lit(" ")).when(which == 1, F.regexp_replace(said, r"\}$", "")).when(which == 2, F.replace(said, F.lit("'user': "), F.lit("'user': 'u', 'id': ")))
    raw = F.when(which == 3, F.lit(None).cast("string")).otherwise(F.coalesce(raw, F.when(which == 4, F.replace(said, F.lit("'user'"), F.lit("'other'"))).otherwise(said)))
    literal = table(spark, sf, "events").select("event_id", readers.typed_literal(raw).alias("l"))
    user = literal.select("event_id", readers.literal_field(F.col("l"), "$.user", "bigint").alias("u"), readers.literal_field(F.col("l"), "$.kind", "string").alias("k"))
    return user.select("event_id", F.col("u.value").alias("user_id"), F.col("u.problem").alias("user_problem"), F.col("k.value").alias("kind"), F.col("k.problem").alias("kind_problem"))


QUERIES = {f.__name__: f for f in (contract_counts, literal_errors, csv_scan, csv_splits, json_records, json_finite, parquet_parts, profile_normalise, last_json_lines)}
_SIG = "sha256('[\"' || array_to_string(codes, '\",\"') || '\"]')"
_BUCKET = f"CAST('0x' || substr(sha256({_SIG}), 1, 8) AS BIGINT) % 100"
ORACLES = {
    "contract_counts": """SELECT CASE WHEN o_totalprice <= 20000 THEN 'priced' WHEN o_orderstatus NOT IN ('F', 'O', 'P') THEN 'known_status' WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 'not_urgent_open' ELSE 'none' END AS problem, count(*) AS n, min(o_orderkey) AS first_key
        FROM orders GROUP BY 1""",
    "literal_errors": """WITH e AS (SELECT *, event_id % 6 AS w FROM events)
        SELECT event_id, CASE WHEN w = 5 THEN user_id END AS user_id, CASE w WHEN 0 THEN 'empty' WHEN 1 THEN 'not a literal' WHEN 2 THEN 'wrong type' WHEN 3 THEN 'null' WHEN 4 THEN 'missing' END AS user_problem,
            CASE WHEN w IN (2, 4, 5) THEN event_type END AS kind, CASE w WHEN 0 THEN 'empty' WHEN 1 THEN 'not a literal' WHEN 3 THEN 'null' END AS kind_problem FROM e""",
    "csv_scan": "SELECT CAST(o_custkey AS VARCHAR) AS entity, o_orderpriority AS kind, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(date_trunc('day', o_orderdate))::TIMESTAMP AS last_ts FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY 1, 2",
    "csv_splits": f"""WITH b AS (SELECT o_orderkey AS case_id, list_sort(list_distinct(list('E_' || lpad(CAST(l_partkey % 40 AS VARCHAR), 2, '0')))) AS codes FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
        SELECT CASE WHEN {_BUCKET} < 80 THEN 'train' WHEN {_BUCKET} < 90 THEN 'val' ELSE 'test' END AS split, count(*) AS n, sum(case_id) AS ids, count(DISTINCT {_SIG}) AS signatures FROM b GROUP BY 1""",
    "json_records": """WITH r AS (SELECT o_custkey AS entity, o_totalprice AS v, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, CASE WHEN o_orderkey % 7 = 0 THEN 'value is not a finite number' WHEN o_orderkey % 11 = 0 THEN 'no value' WHEN o_orderkey % 13 = 0 THEN 'date is not a date' ELSE 'none' END AS problem, o_orderkey % 13 = 0 AS undated FROM orders)
        SELECT entity, problem, count(*) AS n, round(coalesce(sum(CASE WHEN problem IN ('none', 'date is not a date') THEN v END), 0), 2) AS total, max(CASE WHEN NOT undated THEN ts END) AS last_ts FROM r GROUP BY 1, 2""",
    "json_finite": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS v, CASE WHEN o_orderkey % 3 <> 0 THEN 1.5 END::DOUBLE AS x, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS a0, 2.0::DOUBLE AS a1 FROM orders",
    "parquet_parts": "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
    "profile_normalise": "SELECT c_custkey, ['male', 'female', 'female', 'male', NULL, 'other'][c_custkey % 6 + 1] AS gender, CASE WHEN c_custkey % 4 <> 0 THEN lower(c_name) || '@example.org' END AS email FROM customer",
    "last_json_lines": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey END AS n, CAST(floor((o_orderkey % 30000) / 365.25) AS INT) AS age FROM orders",
}
