"""Session defaults and the shared scratch location."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# What the library expects; a cluster's own session should be made with the same settings.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_LOCAL_FOLDERS: dict[str, str] = {}
_MARKED: set[str] = set()


def local_session(cores: int | str = "*", app: str = "panelforge", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **DEFAULTS,
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.shuffle.partitions": "8",
        **{k.replace("__", "."): v for k, v in extra.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by `spark.checkpoint.dir`.

    A machine-local folder is made only for a local master with nothing set: on a cluster a
    folder of one machine would lose the written partitions with that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="panelforge-")
    return _LOCAL_FOLDERS[app]


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as its own type."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing existing is overwritten.

    Paths of one name and application lie in one folder, which goes when the driver's JVM ends; until
    then every lazy result can still be read. A driver that was killed leaves it behind, and so does a
    session object without a JVM, which cannot mark it.
    """
    root = f"{shared_folder(spark)}/panelforge/{name}-{spark.sparkContext.applicationId}"
    if root not in _MARKED and getattr(spark, "_jvm", None) is not None:
        fs, place = file_system(spark, root)
        fs.mkdirs(place)
        fs.deleteOnExit(place)
        _MARKED.add(root)
    return f"{root}/{os.urandom(6).hex()}"


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """The frame, computed once and written below the shared folder, read back from there.

    For small frames that a driver-side decision and several later scans need: a lost executor costs
    nothing, and the scans behind it are not run again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
