"""Session, table loading and intermediate tables that survive the loss of an executor."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hamloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        # small tables with much work a row are cut finer than the default would
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.warehouse.dir", os.path.join(tempfile.gettempdir(), "hamloom-warehouse"))
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The test table `name` below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def widen(df: DataFrame) -> DataFrame:
    """df, its rows dealt out anew over all cores if it is smaller than one full partition of a scan per core.

    For work that costs far more than a shuffle of its input: a small table may lie in a few row groups, and thus tasks. A
    large one stays as it lies.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    full = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * full else df


def shared_dir(spark: SparkSession) -> str:
    """A new folder that every executor can reach.

    It lies below spark.checkpoint.dir. Only a local session without that setting gets a temporary folder;
    a cluster without it is refused, for a folder of one machine would lose data with that machine.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="hamloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext._conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    home = f"{base.rstrip('/')}/hamloom-{spark.sparkContext.applicationId}"
    if home not in _HOMES:
        _HOMES.add(home)
        atexit.register(clean_up, spark, home)
    return f"{home}/{uuid.uuid4().hex}"


#: The folders of this process's applications below the shared folder.
_HOMES: set[str] = set()


def clean_up(spark: SparkSession, home: str) -> None:
    """Delete an application's intermediate tables; nothing happens if its session is gone."""
    try:
        drop_dir(spark, home)
    except Exception:  # the session or its JVM has ended before
        pass


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder made by shared_dir, through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: lineage is cut and no executor holds the only copy."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
