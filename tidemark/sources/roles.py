"""Roles that the operators work on, and the projections that bind the given tables to them.

Each role comes twice: as a DataFrame, and as the SQL of a common table expression for the statements the queries are
held against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import dealt
from tidemark.sources.readers import table

#: Classes of point events that count as acute.
ACUTE = ("1-urgent", "2-high")
#: Kinds of measurement that the bound tables hold.
KINDS = ("AF", "AO", "NF", "NO", "RF", "RO")

SQL = {
    "obs": "obs AS (SELECT o_custkey AS entity, o_orderdate AS ts, l_returnflag || l_linestatus AS kind, l_extendedprice AS value, l_linestatus AS unit FROM orders JOIN lineitem ON l_orderkey = o_orderkey)",
    "enc": "enc AS (SELECT o_custkey AS entity, o_orderdate AS ts, lower(trim(o_orderpriority)) AS class FROM orders)",
    "bags": "bags AS (SELECT o_orderkey AS case_id, list_sort(list_distinct(list('E_' || lpad(CAST(l_partkey % 40 AS VARCHAR), 2, '0')))) AS codes, min(o_orderpriority) AS class, min(o_orderdate) AS ts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)",
    "scored": "scored AS (SELECT d.doc_id AS id, d.source AS entity, d.lang AS grp, d.n_chars AS size, l.quality AS label, round(1 / (1 + exp(-(ln(d.n_chars + 1) - 6))), 6) AS p FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL)",
    "reports": """reports AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS conv, l_linenumber AS turn,
        CASE l_linenumber % 5 WHEN 0 THEN 'I have a ' || p_name || '.' WHEN 1 THEN 'I don''t have a ' || p_name || ' but I have pain ' || CAST(p_size % 11 AS VARCHAR) || ' out of 10'
             WHEN 2 THEN 'The ' || p_name || ' is absent, nothing else' WHEN 3 THEN 'There was never any sign of the ' || p_name || ' today'
             ELSE 'Since yesterday: ' || upper(p_name) || ', pain intensity is ' || CAST(p_size % 11 AS VARCHAR) || '/10' END AS text
        FROM lineitem JOIN part ON p_partkey = l_partkey)""",
    "ontology": """part40 AS (SELECT p_partkey % 40 AS k, min(p_name) AS name FROM part GROUP BY 1), ontology AS (SELECT 'E_' || lpad(CAST(k AS VARCHAR), 2, '0') AS code, name,
        CASE k % 8 WHEN 0 THEN 'Do you have any ' || name || ' for a related reason?' WHEN 1 THEN 'Do you smoke near the ' || name || '?' WHEN 2 THEN 'Was the ' || name || ' diagnosed before?'
            WHEN 3 THEN 'Is the ' || name || ' worse at night?' WHEN 4 THEN 'How strong is the ' || name || '?' ELSE 'Do you have a ' || name || '?' END AS question, k % 8 IN (1, 2) AS antecedent, k % 8 = 4 AS has_values FROM part40)""",
    "aliases": "aliases AS (SELECT p_name AS alias, 'C_' || replace(p_name, ' ', '_') AS code FROM (SELECT DISTINCT p_name FROM part))",
}


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity, ts, kind, value, unit``: a measurement for each order line."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_extendedprice")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(
        F.col("o_custkey").alias("entity"),
        F.col("o_orderdate").alias("ts"),
        F.concat("l_returnflag", "l_linestatus").alias("kind"),
        F.col("l_extendedprice").alias("value"),
        F.col("l_linestatus").alias("unit"),
    )


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity, ts, class``: a point event for each order."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("ts"), F.lower(F.trim("o_orderpriority")).alias("class"))


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``case_id, code, class, ts``: the code of each order line, repeats included; lines of an order are in one task of ``dealt``'s size."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("E_"), F.lpad((F.col("l_partkey") % 40).cast("string"), 2, "0")).alias("code"))
    lines = dealt(lines, "l_orderkey", least=int(spark.conf.get("spark.sql.shuffle.partitions")))  # with fewer a join would shuffle them again
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(F.col("l_orderkey").alias("case_id"), "code", F.col("o_orderpriority").alias("class"), F.col("o_orderdate").alias("ts"))


def bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``case_id, codes, class, ts``: the sorted distinct codes of each order."""
    return coded(spark, sf_dir).groupBy("case_id").agg(F.sort_array(F.collect_set("code")).alias("codes"), F.min("class").alias("class"), F.min("ts").alias("ts"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, entity, grp, size, label, p``: labelled documents with a probability made from their length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where("quality is not null")
    p = F.round(1 / (1 + F.exp(-(F.log(F.col("n_chars") + 1) - 6))), 6)
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.col("source").alias("entity"), F.col("lang").alias("grp"), F.col("n_chars").alias("size"), F.col("quality").alias("label"), p.alias("p"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, conv, turn, text``: a sentence for each order line, in five wordings."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    name, level = F.col("p_name"), (F.col("p_size") % 11).cast("string")
    kind = F.col("l_linenumber") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("I have a "), name, F.lit(".")))
        .when(kind == 1, F.concat(F.lit("I don't have a "), name, F.lit(" but I have pain "), level, F.lit(" out of 10")))
        .when(kind == 2, F.concat(F.lit("The "), name, F.lit(" is absent, nothing else")))
        .when(kind == 3, F.concat(F.lit("There was never any sign of the "), name, F.lit(" today")))
        .otherwise(F.concat(F.lit("Since yesterday: "), F.upper(name), F.lit(", pain intensity is "), level, F.lit("/10")))
    )
    joined = lines.join(parts, F.col("p_partkey") == F.col("l_partkey"))
    return joined.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("conv"), F.col("l_linenumber").alias("turn"), text.alias("text"))


def ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``code, name, question, data_type, values, antecedent``: an entry for each code of ``bags``, in six wordings."""
    parts = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 40).alias("k")).agg(F.min("p_name").alias("name"))
    name, kind = F.col("name"), F.col("k") % 8
    question = (
        F.when(kind == 0, F.concat(F.lit("Do you have any "), name, F.lit(" for a related reason?")))
        .when(kind == 1, F.concat(F.lit("Do you smoke near the "), name, F.lit("?")))
        .when(kind == 2, F.concat(F.lit("Was the "), name, F.lit(" diagnosed before?")))
        .when(kind == 3, F.concat(F.lit("Is the "), name, F.lit(" worse at night?")))
        .when(kind == 4, F.concat(F.lit("How strong is the "), name, F.lit("?")))
        .otherwise(F.concat(F.lit("Do you have a "), name, F.lit("?")))
    )
    code = F.concat(F.lit("E_"), F.lpad(F.col("k").cast("string"), 2, "0"))
    values = F.when(kind == 4, F.array(F.lit("0"), F.lit("1")))
    return parts.select(code.alias("code"), "name", question.alias("question"), F.when(kind == 4, "C").otherwise("B").alias("data_type"), values.alias("values"), kind.isin(1, 2).alias("antecedent"))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``alias, code``: each distinct product name is an alias of a code of its own."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select(F.col("p_name").alias("alias"), F.concat(F.lit("C_"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("code"))
