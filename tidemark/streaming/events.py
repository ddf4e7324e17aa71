"""Windows, sessions, deduplication and incremental refresh on event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import shared_folder


#: Folders that a history is dealt into.
PARTS = 64


def event_stream(spark: SparkSession, path: str, delay: str = "10 minutes", files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of events as a stream, ``ts`` as a timestamp with a watermark; ``path`` is a folder, a file or a pattern."""
    schema = spark.read.parquet(path).schema
    if not any(c in path for c in "*?["):  # a stream takes a single file only by a pattern
        path = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def counted(events: DataFrame, window: Column, by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Rows and summed values in each window and group."""
    rolled = events.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return rolled.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return counted(events, F.window("ts", width))


def sliding(events: DataFrame, width: str = "6 hours", slide: str = "2 hours") -> DataFrame:
    return counted(events, F.window("ts", width, slide))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return counted(events, F.session_window("ts", gap), ("user_id",))


def distinct(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The first row of each key that arrives within the watermark."""
    return events.dropDuplicatesWithinWatermark(list(keys))


def measured(events: DataFrame, limits: tuple[float, ...], width: str = "1 hour") -> DataFrame:
    """Per window and kind: how many values there were up to each limit, all of them, and their sum, as a metrics endpoint gives them."""
    counts = [F.count(F.when(F.col("value") <= x, 1)).alias(f"le_{str(x).replace('.', '_')}") for x in limits]
    rolled = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(*counts, F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return rolled.select(F.col("w.start").alias("start"), "event_type", *[c for c in rolled.columns if c not in ("w", "event_type")])


def followed(first: DataFrame, then: DataFrame, within: str = "INTERVAL 1 HOUR", key: str = "user_id") -> DataFrame:
    """Pairs of two streams: events of ``then`` after one of ``first`` of the same key, no later than ``within``.

    Both have ``event_id, ts`` and the key, and a watermark, so the state holds no more than that time of either stream.
    """
    a = first.select(F.col(key).alias("_k"), F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts"))
    b = then.select(F.col(key), F.col("event_id").alias("then_id"), F.col("ts").alias("then_ts"))
    met = a.join(b, F.expr(f"_k = {key} AND then_ts > first_ts AND then_ts <= first_ts + {within}"))
    return met.select(key, "first_id", "then_id", "first_ts", "then_ts")


def drained(stream: DataFrame) -> DataFrame:
    """Everything that the stream gives on the input at hand, written as Parquet (exactly once) and read back.

    Windows still open at the watermark are not given, as in any append-mode stream.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def refreshed(stream: DataFrame, history_path: str, result_path: str, key: str, compute: Callable[[DataFrame], DataFrame]) -> None:
    """Appends each batch to the history and recomputes ``compute`` for the keys that the batch touches.

    The history lies in folders by a hash of the key, and only those that the batch touches are read. Results are written in
    a folder for each batch; the latest batch that holds a key has its current result. A batch that is run again writes its
    folders anew, so a restart neither loses nor doubles rows.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")
        rows.withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(f"{history_path}/batch={number}")
        parts = [r[0] for r in rows.select(part).distinct().collect()]  # at most PARTS numbers
        schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.IntegerType()), T.StructField("part", T.IntegerType())])
        history = spark.read.option("basePath", history_path).schema(schema).parquet(history_path).where(F.col("part").isin(parts) & (F.col("batch") <= number))
        touched = history.drop("batch", "part").join(rows.select(key).distinct(), key, "left_semi")
        compute(touched).write.mode("overwrite").parquet(f"{result_path}/batch={number}")

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{result_path}/_state").trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, result_path: str, key: str) -> DataFrame:
    """The latest result of each key from the folders that ``refreshed`` writes."""
    rows = spark.read.option("basePath", result_path).parquet(f"{result_path}/batch=*")
    last = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [key, "batch"]).drop("batch")


def counted_apart(stream: DataFrame, path: str, keys: tuple[str, ...], of: str, log2: int = 12) -> None:
    """Keeps, for each batch and key, the number of rows and a sketch of the distinct values of ``of`` (integers, texts or bytes).

    A batch reads nothing of the history. It writes a folder of its own with a row for each key that it touches, and writes it
    anew if it is run again. The relative error of a sketch is about 1.04 / sqrt(2 ** ``log2``), less for a few hundred values.
    """

    def batch(rows: DataFrame, number: int) -> None:
        sketches = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(of, log2).alias("sketch"))
        sketches.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).start().awaitTermination()


def apart(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """``keys, n, n_distinct`` over all batches that ``counted_apart`` has taken: sums of rows, and estimates from united sketches.

    Sketches unite over any coarser key too, which counts of distinct values do not; nulls count as rows, not as values.
    """
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def values_apart(stream: DataFrame, path: str, keys: tuple[str, ...], of: str) -> None:
    """``counted_apart`` without an error: keeps, for each batch, its distinct values of ``of`` in each key and how many rows have them.

    A batch reads nothing of the history, and rows that repeat are summed up before they are kept.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.groupBy(*keys, F.col(of).alias("_value")).agg(F.count("*").alias("_rows")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).start().awaitTermination()


def values_of(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """``keys, n, n_distinct`` over all batches that ``values_apart`` has taken, exactly; nulls count as rows, not as values.

    Values are united before they are counted, so a hot key is spread over as many tasks as its values ask for.
    """
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    united = rows.groupBy(*keys, "_value").agg(F.sum("_rows").alias("_rows"))
    return united.groupBy(*keys).agg(F.sum("_rows").alias("n"), F.count("_value").alias("n_distinct"))


def latest(stream: DataFrame, key: str) -> DataFrame:
    """The last row of each key that a stream in update mode gives on the input at hand.

    A trigger's rows are written in a folder of its own, anew if it is run again.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark)

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return current(spark, f"{folder}/out", key)
