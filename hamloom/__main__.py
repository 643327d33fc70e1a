"""Command line: python -m hamloom COMMAND ... Exit code 0, 1 for bad input or a failed check, 2 for bad usage."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hamloom.operators import search
from hamloom.plans import runs
from hamloom.session import materialise
from hamloom.sources import datasets
from hamloom.sources.manifests import read_labels, read_plain_tags, read_tag_manifest, read_uploads, with_labels
from hamloom.sources.sinks import write_csv
from hamloom.streaming.uploads import UploadStore

COUNTERS = runs.COUNTERS


def lookup(spark: SparkSession, records: str, queries: str, out: str, threshold: int = 6, fpp: float = 0.01, strategies: str = "scan,exact,prefuzz", repeat: int = 1, verify: bool = False) -> None:
    """Radius search of a query manifest in a record manifest: the counters of every query, strategy and repeat as CSV."""
    chosen = strategies.split(",")
    if unknown := set(chosen) - {"scan", "exact", "prefuzz"}:
        raise ValueError(f"unknown strategies {sorted(unknown)}")
    r = materialise(read_tag_manifest(spark, records))
    q = materialise(read_tag_manifest(spark, queries).withColumnRenamed("id", "query_id"))
    if verify:
        first = materialise(search.radius_scan(r, q, f"default={threshold}"))
        for other in (search.radius_exact(r, q, f"default={threshold}"), search.radius_prefuzz(r, q, threshold, fpp)):
            if search.differences(first, other).take(1):
                raise ValueError("the strategies find different records")
    out_rows = None
    for k in range(repeat):
        rows, mean = runs.timed(lambda: search.radius_counters(r, q, threshold, fpp).filter(F.col("strategy").isin(chosen)))
        rows = rows.withColumns({"repeat": F.lit(k), "latency_us": F.lit(round(mean)).cast("bigint")})
        out_rows = rows if out_rows is None else out_rows.unionByName(rows)
    write_csv(out_rows.orderBy("repeat", "strategy", "query_id"), out, ["strategy", "query_id", "type", "repeat", "latency_us", *COUNTERS])


def compare(spark: SparkSession, records: str, queries: str, out: str, labels: str | None = None, thresholds: str = "4,5,6", repeat: int = 2, schemes: str = "global_min,first_match") -> None:
    """Global minimum and first match of every query at every threshold and repeat as CSV; records may repeat ids, types don't count."""
    r = materialise(read_plain_tags(spark, records))
    q = read_plain_tags(spark, queries).select(F.col("id").alias("query_id"), "tag")
    q = materialise(with_labels(q, read_labels(spark, labels)) if labels else q.withColumn("group", F.lit("")))
    rows = materialise(runs.comparative(r, q, [int(t) for t in thresholds.split(",")], repeat, tuple(schemes.split(","))))
    write_csv(rows.withColumn("latency_us", F.format_string("%.3f", "latency_us")).orderBy("scheme", "repeat", "query_id", "turn"), out, runs.COMPARATIVE)


def setup(spark: SparkSession, store: str, threshold: str = "default=6", capacity: int = 1000, fpp: float = 0.01) -> dict:
    """Make a store's settings, or change them as far as what is stored allows."""
    kept = UploadStore(spark, store, None, capacity, fpp)
    kept.setup(threshold, capacity, fpp)
    return kept.config


#: Files of an upload list that are decided at once; where a list is cut makes no difference.
FILES = 100_000


def _decide(spark: SparkSession, ups, store: str, threshold: str | None) -> dict[str, int]:
    """Decide uploads (uid, type, path, position) in blocks of FILES, whose paths pass through the driver."""
    if missing := ups.filter("type <> 'text'").take(1):
        raise ValueError(f"no adapter for type {missing[0]['type']!r}")
    kept = UploadStore(spark, store, threshold)
    number, first = kept.next()
    start, total = number, ups.count()
    for low in range(0, total, FILES):
        part = ups.filter((F.col("position") >= low) & (F.col("position") < low + FILES))
        paths = [r["path"] for r in part.select("path").distinct().collect()]
        files = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.decode("content", "ISO-8859-1").alias("content"))
        name = F.concat_ws("/", "uid", F.lit(str(start)), F.col("position").cast("string"))
        kept.add(part.join(files, "path").select(name.alias("id"), "uid", (F.col("position") + first).alias("pos"), "type", "content"), number)
        number += 1
    row = kept.decisions().filter(F.col("batch") >= start).agg(F.count(F.lit(1)).alias("processed"), F.count_if("stored").alias("stored")).first()
    return {"processed": row["processed"], "stored": row["stored"], "reused": row["processed"] - row["stored"]}


def bulk_upload(spark: SparkSession, manifest: str, store: str, threshold: str | None = None) -> dict[str, int]:
    """Store or reuse the files of an upload list, in its order; returns the numbers processed, stored and reused.

    An upload's id is its user, the list's number and its place in it, so no two lists share ids.
    """
    return _decide(spark, read_uploads(spark, manifest), store, threshold)


def upload(spark: SparkSession, uid: str, kind: str, file: str, store: str, threshold: str | None = None) -> dict[str, int]:
    """Store or reuse one file of a user."""
    one = spark.createDataFrame([(uid, kind, file, 0)], "uid string, type string, path string, position bigint")
    return _decide(spark, one, store, threshold)


def list_refs(spark: SparkSession, uid: str, store: str) -> list[str]:
    """The representatives that a user refers to."""
    return [r["rid"] for r in UploadStore(spark, store).refs(uid).select("rid").orderBy("rid").collect()]  # one user's


def self_test(spark: SparkSession) -> dict[str, bool]:
    got = runs.self_test(spark)
    if not all(got.values()):
        raise ValueError(f"failed: {[k for k, ok in got.items() if not ok]}")
    return got


def benchmark(spark: SparkSession, rounds: int = 3) -> dict[str, float]:
    return runs.benchmark(rounds)


def prepare(spark: SparkSession, root: str, out: str, expected: int | None = None) -> dict:
    return datasets.prepare(spark, root, out, expected=expected)


def verify(spark: SparkSession, dataset: str, root: str, report: str) -> dict:
    got = datasets.verify(spark, dataset, root, report)
    if not got["ok"]:
        raise ValueError(f"faults: {got['faults']}")
    return got


#: Options of every command: name, type or "flag", and its default or None where it must be given.
REQUIRED = object()
COMMANDS: dict[str, tuple] = {
    "lookup": (lookup, {"records": (str, REQUIRED), "queries": (str, REQUIRED), "out": (str, REQUIRED), "threshold": (int, 6), "fpp": (float, 0.01), "strategies": (str, "scan,exact,prefuzz"), "repeat": (int, 1), "verify": ("flag", False)}),
    "compare": (compare, {"records": (str, REQUIRED), "queries": (str, REQUIRED), "out": (str, REQUIRED), "labels": (str, None), "thresholds": (str, "4,5,6"), "repeat": (int, 2), "schemes": (str, "global_min,first_match")}),
    "setup": (setup, {"store": (str, REQUIRED), "threshold": (str, "default=6"), "capacity": (int, 1000), "fpp": (float, 0.01)}),
    "upload": (upload, {"uid": (str, REQUIRED), "kind": (str, "text"), "file": (str, REQUIRED), "store": (str, REQUIRED), "threshold": (str, None)}),
    "bulk-upload": (bulk_upload, {"manifest": (str, REQUIRED), "store": (str, REQUIRED), "threshold": (str, None)}),
    "list-refs": (list_refs, {"uid": (str, REQUIRED), "store": (str, REQUIRED)}),
    "self-test": (self_test, {}),
    "benchmark": (benchmark, {"rounds": (int, 3)}),
    "prepare": (prepare, {"root": (str, REQUIRED), "out": (str, REQUIRED), "expected": (int, None)}),
    "verify": (verify, {"dataset": (str, REQUIRED), "root": (str, REQUIRED), "report": (str, REQUIRED)}),
    "run": (runs.run, {"dataset": (str, REQUIRED), "out": (str, REQUIRED), "benchmark": (int, 1000), "pool": (int, None), "seed": (int, 1), "thresholds": (str, "4,5,6"), "repeats": (int, 1)}),
    "analyse": (runs.analyse, {"a": (str, REQUIRED), "b": (str, REQUIRED), "out": (str, REQUIRED)}),
}


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="hamloom")
    sub = top.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        p = sub.add_parser(name)
        for option, (kind, default) in options.items():
            if kind == "flag":
                p.add_argument(f"--{option}", action="store_true")
            else:
                p.add_argument(f"--{option}", type=kind, required=default is REQUIRED, default=None if default is REQUIRED else default)
    given = vars(top.parse_args(args))
    try:
        print(COMMANDS[given.pop("command")][0](SparkSession.builder.getOrCreate(), **given) or "done")
    except Exception as e:
        print(f"error: {str(e)[:500]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
