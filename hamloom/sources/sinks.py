"""Writers: projected CSV, staged publication, inventories, JSON and Markdown."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The given columns with a header and LF line ends; further ones are dropped. Refuses a folder that exists."""
    df.select(*columns).write.mode("errorifexists").csv(path, header=True, lineSep="\n", escape='"')


def publish(spark: SparkSession, target: str, write: Callable[[str], None], check: Callable[[str], None] = lambda _: None) -> None:
    """Write to a folder beside target, check it, then rename: readers see all or nothing. Refuses a target that exists.

    Both are of the target's file system (Hadoop's), not of one machine; on object stores a rename is a copy.
    """
    jvm = spark.sparkContext._jvm
    end, staging = jvm.org.apache.hadoop.fs.Path(target), jvm.org.apache.hadoop.fs.Path(f"{target}.staging")
    fs = end.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(end):
        raise FileExistsError(target)
    fs.delete(staging, True)
    try:
        write(f"{target}.staging")
        check(f"{target}.staging")
        if not fs.rename(staging, end):
            raise OSError(f"{target} could not be put in place")
    finally:
        fs.delete(staging, True)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, sha256) of every file below root."""
    from hamloom.sources.manifests import read_files

    return read_files(spark, root).select("path", "length", F.sha2("content", 256).alias("sha256"))


def changed(now: DataFrame, listed: DataFrame) -> DataFrame:
    """(path, problem) of files that are missing, unlisted or changed against a list (path, length, sha256)."""
    at = now.alias("a").join(listed.alias("b"), F.col("a.path") == F.col("b.path"), "full_outer")
    what = F.when(F.col("a.path").isNull(), "missing").when(F.col("b.path").isNull(), "unlisted").when((F.col("a.sha256") != F.col("b.sha256")) | (F.col("a.length") != F.col("b.length")), "changed")
    return at.select(F.coalesce("a.path", "b.path").alias("path"), what.alias("problem")).filter("problem is not null")


def write_json_to(spark: SparkSession, value: dict, path: str) -> None:
    """value as JSON in a folder that all executors share, through Hadoop's file system; an older file is replaced."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray((json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()))
    out.close()


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The JSON object that write_json_to wrote, or None without a file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))  # a few lines


def write_json(value: dict, path: str) -> None:
    """Sorted keys, a line end at the end."""
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n", "utf-8")


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A table of at most `most` rows; more fail, for a report is read by people."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    lines = [df.columns, ["---"] * len(df.columns), *[["" if v is None else str(v) for v in r] for r in rows]]
    return "".join("| " + " | ".join(x.replace("|", "\\|") for x in line) + " |\n" for line in lines)
