"""Shared pieces of the operators that link documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.session import scratch_path, shared_folder


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Let the session send texts to Python in batches of at most `most` bytes (64 MB unless set).

    A batch is held by the JVM, by the worker and by what is made of it at once. The setting
    is read when a plan is run, so it stays with the session; a smaller one that is set already stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if size(spark.conf.get(key)) > size(most):
        spark.conf.set(key, most)


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Kept:
    """Frames written as tables in the shared folder, which can be dropped together once nothing that
    reads them will run again."""

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self._spark, "kept")
        df.write.parquet(path)
        self._paths.append(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self._paths:
            place = self._spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(place, True)
        self._paths = []


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node`, `root`: the smallest node of each connected component of the links.

    Every round points each node to its smallest neighbour, if that is smaller, follows the pointers
    twice, and moves the links to the nodes they point to; links inside one node vanish. The
    frames of a round hold two numbers a row and are checkpointed.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    edges = checkpointed(edges)
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("up"))
        point = least.select(F.col("a").alias("node"), "up")
        for _ in range(2):
            onward = point.select(F.col("node").alias("up"), F.col("up").alias("next"))
            point = point.join(onward, "up", "left").select(
                "node", F.coalesce("next", "up").alias("up")
            )
        point = checkpointed(point)
        if roots is None:
            roots = point.withColumnRenamed("up", "root")
        else:
            step = point.select(F.col("node").alias("root"), "up")
            roots = roots.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        roots = checkpointed(roots)
        to_a = point.select(F.col("node").alias("a"), F.col("up").alias("na"))
        to_b = point.select(F.col("node").alias("b"), F.col("up").alias("nb"))
        moved = edges.join(to_a, "a").join(to_b, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
        edges = checkpointed(moved.filter("a <> b").distinct())
    if roots is None:
        kind = dict(edges.dtypes)["a"]
        return empty(links.sparkSession, f"node {kind}, root {kind}")
    return roots
