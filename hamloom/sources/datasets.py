"""Datasets made from mail folders, their verification, and what is recorded about a run's surroundings."""

from __future__ import annotations

import os
import platform
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hamloom.functions.text import TAG_DOMAIN, normalised, simhash, text_tag, words
from hamloom.session import materialise, widen
from hamloom.sources.manifests import read_csv, read_maildir
from hamloom.sources.sinks import publish, write_csv, write_json_to

MANIFEST = ["id", "mailbox", "source_path", "body_sha256", "body_size_bytes", "normalized_word_count"]
METADATA = ["id", "mailbox", "source_path", "body_sha256", "body_size_bytes", "normalized_sha256", "normalized_word_count"]
#: Inputs whose tags are written with every dataset, so that another implementation can be checked against them.
EDGE_CASES = {
    "nothing": b"",
    "a_word": b"harbour",
    "a_pair": b"harbour lights",
    "a_triple": b"harbour lights fade",
    "five_words": b"the harbour lights fade slowly",
    "case_and_signs": b"The HARBOUR... lights? (fade)",
    "line_ends": b"the\r\nharbour\tlights\n\nfade",
    "same_word": b"row row row row row row",
    "other_letters": "grüß café naïve 日本 lights fade".encode(),
}
SAMPLES = 20


def mails(spark: SparkSession, root: str, expected: int | None = None) -> DataFrame:
    """(id, mailbox, source_path, body, body_sha256, body_size_bytes, normalized_sha256, normalized_word_count) of a mail folder."""
    rows = read_maildir(spark, root, expected)
    raw = F.encode("body", "ISO-8859-1")
    made = [F.sha2(raw, 256).alias("body_sha256"), F.octet_length(raw).cast("bigint").alias("body_size_bytes"), F.sha2(normalised("body"), 256).alias("normalized_sha256"), F.size(words("body")).cast("bigint").alias("normalized_word_count")]
    return rows.select("id", "mailbox", F.col("path").alias("source_path"), "body", *made)


def prepare(spark: SparkSession, root: str, out: str, domain: str = TAG_DOMAIN, expected: int | None = None) -> dict:
    """Make a dataset of the mails below root: tags, manifest, metadata, normalised tags and edge cases as CSV folders, and summary.json.

    Every distinct normalised text is tagged once. The folder `out` must not exist; it appears whole, after its tags were read back.
    """
    rows = materialise(mails(spark, root, expected))
    distinct = rows.groupBy("normalized_sha256").agg(F.min("body").alias("body"))
    tagged = materialise(widen(distinct).select("normalized_sha256", text_tag("body", domain).alias("tag_hex")))
    edges = spark.createDataFrame([(k, v.hex(), simhash(v, domain).hex()) for k, v in EDGE_CASES.items()], "name string, input_hex string, expected_hex string")
    total = rows.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("body_sha256").alias("distinct_bodies"), F.countDistinct("normalized_sha256").alias("distinct_texts"), F.coalesce(F.sum("normalized_word_count"), F.lit(0)).alias("words"), F.count_if(F.col("normalized_word_count") == 0).alias("without_words")).first().asDict()

    def write(at: str) -> None:
        write_csv(rows.join(tagged, "normalized_sha256").select("id", F.lit("text").alias("type"), "tag_hex"), f"{at}/tags.csv", ["id", "type", "tag_hex"])
        write_csv(rows, f"{at}/manifest.csv", MANIFEST)
        write_csv(rows, f"{at}/metadata.csv", METADATA)
        write_csv(tagged, f"{at}/normalized_tags.csv", ["normalized_sha256", "tag_hex"])
        write_csv(edges, f"{at}/edge_cases.csv", ["name", "input_hex", "expected_hex"])
        write_json_to(spark, total | {"domain": domain}, f"{at}/summary.json")

    def check(at: str) -> None:
        if (n := spark.read.csv(f"{at}/tags.csv", header=True).count()) != total["records"]:
            raise ValueError(f"{n} tags of {total['records']} records")

    publish(spark, out, write, check)
    return total


def verify(spark: SparkSession, dataset: str, root: str, report: str, domain: str = TAG_DOMAIN) -> dict:
    """Check a dataset against the mails it was made of and write a report (JSON) with counts and at most SAMPLES faults.

    Tags and digests are made anew; ids without the other side, tags that aren't 64 hex digits, repeated ids and files that begin
    with a byte order mark are faults. A source path that ends in "_" also stands for the one that ends in "." there, for
    some file systems don't keep that.
    """
    tags = read_csv(spark, f"{dataset}/tags.csv", "id string, type string, tag_hex string")
    manifest = read_csv(spark, f"{dataset}/manifest.csv", "id string, mailbox string, source_path string, body_sha256 string, body_size_bytes bigint, normalized_word_count bigint")
    now = materialise(mails(spark, root).select(F.regexp_replace("source_path", r"\.\z", "_").alias("at"), "body", F.col("body_sha256").alias("digest")))
    kept = manifest.select("id", F.regexp_replace("source_path", r"\.\z", "_").alias("at"), "body_sha256").join(tags, "id", "full_outer")
    both = widen(kept.join(now, "at", "left")).withColumn("made", text_tag("body", domain))
    readable = F.col("tag_hex").rlike(r"^[0-9a-f]{64}\z")
    fault = (
        F.when(F.col("tag_hex").isNull(), "no tag").when(F.col("at").isNull(), "no record").when(F.col("body").isNull(), "no mail")
        .when(~readable, "unreadable tag").when(F.col("body_sha256") != F.col("digest"), "another body").when(F.col("tag_hex") != F.col("made"), "another tag")
    )
    rows = materialise(both.select("id", fault.alias("fault")))
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("repeated id").alias("fault"))
    starts = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(dataset)
    marked = starts.filter(F.substring("content", 1, 3) == F.lit(b"\xef\xbb\xbf")).select(F.col("path").alias("id"), F.lit("byte order mark").alias("fault"))
    faults = materialise(rows.filter("fault is not null").unionByName(repeated).unionByName(marked))
    counts = {r["fault"]: r["n"] for r in faults.groupBy("fault").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per kind of fault
    samples = [r.asDict() for r in faults.orderBy("fault", "id").limit(SAMPLES).collect()]
    result = {"checked": rows.count(), "faults": counts, "samples": samples, "ok": not counts}
    write_json_to(spark, result, report)
    return result


def edge_case_faults(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """(name, expected, made) of a CSV (name, input_hex, expected_hex) whose tags come out otherwise in a domain."""
    rows = read_csv(spark, path, "name string, input_hex string, expected_hex string")
    made = rows.select("name", F.lower("expected_hex").alias("expected"), text_tag(F.coalesce(F.unhex("input_hex"), F.lit(b"")), domain).alias("made"))
    return made.filter("expected <> made")


def environment(spark: SparkSession) -> dict:
    """Versions, the session's settings that matter, and this machine's processor and memory as far as they can be read."""
    read = lambda p: Path(p).read_text() if os.path.exists(p) else ""
    cpu = re.search(r"^model name\s*:\s*(.+)$", read("/proc/cpuinfo"), re.M)
    memory = re.search(r"^MemTotal:\s*(\d+)", read("/proc/meminfo"), re.M)
    conf = spark.sparkContext.getConf()
    return {
        "spark": spark.version,
        "python": platform.python_version(),
        "java": spark.sparkContext._jvm.java.lang.System.getProperty("java.version"),
        "kernel": platform.release(),
        "machine": platform.machine(),
        "cpu": cpu[1] if cpu else None,
        "memory_kb": int(memory[1]) if memory else None,
        "cores": spark.sparkContext.defaultParallelism,
        "master": conf.get("spark.master"),
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }


def sizes(spark: SparkSession, root: str) -> DataFrame:
    """(part, files, bytes) of the folders and files directly below root."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    base = "^" + re.escape(Path(root).resolve().as_uri().replace("file://", "file:").rstrip("/")) + "/"
    part = F.substring_index(F.regexp_replace("path", base, ""), "/", 1)
    return rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
