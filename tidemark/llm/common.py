"""What the operators of this subpackage share: table access, durable intermediate tables, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by a path that Spark's readers resolve."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one under /tmp on a single machine where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not folder:
        folder = f"file:///tmp/spark-tidemark-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def durable(frame: DataFrame) -> DataFrame:
    """``frame`` written once as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


#: Name of the column that tells rows apart, whatever their ids.
ROW = "_tidemark_row"


def numbered(frame: DataFrame) -> DataFrame:
    """``frame`` with a number of its own in each row, written so that it stays the same."""
    return durable(frame.withColumn(ROW, F.monotonically_increasing_id()))


def join_spread(rows: DataFrame, named: DataFrame, keys: list[str], weight: str, total: int, heavy: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``named`` (one row a key), so that no task gets all rows of a hot key.

    ``weight`` counts the rows of each key, ``total`` all rows. Keys that hold over one ``heavy``-th of the rows, fewer
    than ``heavy`` by their definition, are broadcast and joined where the rows are; the others are joined by a shuffle.
    ``rows`` is read twice, so it should be a written table.
    """
    hot = F.broadcast(named.where(F.col(weight) * heavy > total))
    cold = named.where(F.col(weight) * heavy <= total)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star rounds.

    ``edges`` has two long columns ``a`` and ``b``. Returns ``node, component`` for every node of an edge, where
    ``component`` is the smallest node reachable. Self loops and repeated edges do no harm; null ends are ignored; no
    edges give no rows. Each round is two joins with pre-aggregated minima, those of hubs where their rows are, and is
    written to the shared folder, so neither a hub's neighbours nor the graph meet in one task or on the driver.
    """
    e = durable(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    rows = e.count()
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is tied to the smallest of u and its neighbours
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_n"))
        large = durable(join_spread(both, least, ["u"], "_n", 2 * rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: u and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        small = (
            join_spread(large, low, ["u"], "_n", rows)
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        e = durable(small)
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, rows = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
