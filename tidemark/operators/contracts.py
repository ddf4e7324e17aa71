"""Contracts on rows, judged in the pass that writes them: rows that break one fail the job or are set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.session import shared_folder


def problem(rules: dict[str, Column]) -> Column:
    """The name of the first rule that a row does not meet (a null counts as not met); null for a good row."""
    found = F.lit(None).cast("string")
    for name, rule in reversed(rules.items()):
        found = F.when(F.coalesce(rule, F.lit(False)), found).otherwise(F.lit(name))
    return found


def judged(rows: DataFrame, rules: dict[str, Column], seen: Observation | None = None) -> DataFrame:
    """``rows`` with ``problem``; ``seen`` gets the number of rows and of each problem from the pass that reads the result."""
    marked = rows.withColumn("problem", problem(rules))
    counts = [F.count(F.when(F.col("problem") == name, 1)).alias(name) for name in rules]
    return marked.observe(seen, F.count(F.lit(1)).alias("rows"), *counts) if seen else marked


def required(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` as they are; reading one that breaks a rule raises an error with the rule's name and the row."""
    broken = F.raise_error(F.concat(F.lit("row breaks the rule: "), F.col("problem"), F.lit(" "), F.to_json(F.struct(*rows.columns))))
    marked = judged(rows, rules).withColumn("_ok", F.when(F.col("problem").isNull(), F.lit(True)).otherwise(broken.cast("boolean")))
    return marked.where("_ok").select(*rows.columns)


def set_apart(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Good rows, the others with their ``problem``, and how many rows and problems there were.

    One pass writes both, in folders by whether there is a problem; nothing is read a second time to be counted.
    """
    spark, seen, path = rows.sparkSession, Observation(), shared_folder(rows.sparkSession)
    marked = judged(rows, rules, seen)
    marked.withColumn("_bad", F.col("problem").isNotNull()).write.partitionBy("_bad").parquet(path)
    back = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in marked.schema)}, _bad boolean").parquet(path)
    return back.where("NOT _bad").select(*rows.columns), back.where("_bad").drop("_bad"), seen.get
