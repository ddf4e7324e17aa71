"""The query catalogue: name -> callable(spark, sf_dir), and the SQL each one is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import corpus, language, longitudinal, lookup_queries, scoring, serving_rules, source_queries, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**longitudinal.QUERIES, **scoring.QUERIES, **corpus.QUERIES, **language.QUERIES, **serving_rules.QUERIES, **lookup_queries.QUERIES, **source_queries.QUERIES, **streams.QUERIES}
ORACLES: dict[str, str] = {**longitudinal.ORACLES, **scoring.ORACLES, **corpus.ORACLES, **language.ORACLES, **serving_rules.ORACLES, **lookup_queries.ORACLES, **source_queries.ORACLES, **streams.ORACLES}
