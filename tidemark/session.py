"""Session settings shared by tests, the benchmark and applications."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that every plan in this library assumes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors reach: under spark.checkpoint.dir, or under /tmp on a single machine where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file:///tmp/spark-tidemark-{uuid.uuid4().hex}"
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """``frame`` written once as Parquet in the shared folder and read again, for what several branches of a plan read."""
    path = shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


#: Rows that a task gets of those that ``dealt`` deals out.
ROWS_A_TASK = 250_000


def dealt(rows: DataFrame, *keys: str, a_task: int = ROWS_A_TASK, least: int = 1) -> DataFrame:
    """``rows`` of a table shuffled by ``keys`` to so many tasks that each has about ``a_task`` of them, however large the table is.

    For groups of a few rows each, of which nothing could be merged before a shuffle: what is then grouped by ``keys``, or by
    these and others, needs no further one. Counting a table's rows reads no more than its files' footers.
    """
    least = max(least, rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(max(least, -(-rows.count() // a_task)), *keys)


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "12g", name: str = "tidemark") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
