"""Strict readers of manifests, labels, uploads, key-value lines and mail folders."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hamloom.functions.text import extract_body, metadata_line, split_fields, trim_field, typed_value
from hamloom.operators.skew import with_positions


#: The order of lines: files by path, the parts of a file by their first byte, the lines of a part as they are read.
LINES = ["file", "start", "line"]


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start, line) of text lines; LINES orders them however files were cut and packed into tasks."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return lines.withColumn("line", F.monotonically_increasing_id())


def _positions(rows: DataFrame, name: str) -> DataFrame:
    """Number rows with LINES from 0; see skew.with_positions."""
    return with_positions(rows, LINES, name).drop(*LINES)


def _checked(rows: DataFrame, bad, message: str) -> DataFrame:
    """rows, failing while they are read where `bad` holds."""
    return rows.filter(F.when(bad, F.raise_error(F.concat(F.lit(message + ": "), F.coalesce("value", F.lit(""))))).otherwise(F.lit(True)))


def read_tag_manifest(spark: SparkSession, path: str, bits: int = 256) -> DataFrame:
    """(id, type, tag, record_id) of a CSV of three fields.

    Fields are trimmed; blank lines, lines that begin with # and header lines anywhere are skipped. Anything but three
    fields that aren't empty, a tag of another width or with other than hex digits fails, as do repeated ids and a file without
    records. record_id is the position, from 0.
    """
    fields = split_fields("value")
    rows = _numbered(spark, path).withColumn("f", fields).withColumn("t", trim_field("value"))
    rows = rows.filter((F.col("t") != "") & ~F.startswith("t", F.lit("#")) & ~((F.size("f") == 3) & (F.lower(F.col("f")[0]) == "id") & (F.lower(F.col("f")[1]) == "type")))
    wrong = (F.size("f") != 3) | F.exists("f", lambda x: x == "") | ~F.col("f")[2].rlike(rf"^[0-9a-fA-F]{{{bits // 4}}}\z")
    rows = _checked(rows, F.coalesce(wrong, F.lit(True)), "bad manifest line")
    out = _positions(rows.select(F.col("f")[0].alias("id"), F.col("f")[1].alias("type"), F.lower(F.col("f")[2]).alias("tag"), *LINES), "record_id")
    twice = out.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").take(1)
    if twice:
        raise ValueError(f"id {twice[0]['id']!r} occurs {twice[0]['n']} times")
    if out.isEmpty():
        raise ValueError(f"no records in {path}")
    return out


def read_plain_tags(spark: SparkSession, path: str) -> DataFrame:
    """(id, tag, record_id) of a CSV of three fields for comparisons without regard to type: ids may repeat, types are ignored.

    Only line ends are stripped; a line whose first field is id is a header; a tag that isn't 64 hex digits fails.
    """
    rows = _numbered(spark, path).withColumn("f", F.split(F.regexp_replace("value", r"[\r\n]+\z", ""), ",", -1)).filter((F.col("f")[0] != "id") & (F.col("value") != ""))
    wrong = (F.size("f") < 3) | ~F.get("f", F.lit(2)).rlike(r"^[0-9a-fA-F]{64}\z")
    rows = _checked(rows, F.coalesce(wrong, F.lit(True)), "bad record line")
    return _positions(rows.select(F.col("f")[0].alias("id"), F.lower(F.col("f")[2]).alias("tag"), *LINES), "record_id")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV with a header that must match the schema; doubled quotes stand for one; malformed rows fail."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST", quote='"', escape='"', multiLine=True)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, group, body_sha256, source_id) of a label file; of repeated ids the first line counts."""
    rows = read_csv(spark, path, "query_id string, group string, body_sha256 string, source_id string").withColumn("_l", F.monotonically_increasing_id())
    cols = ["group", "body_sha256", "source_id"]
    return rows.groupBy("query_id").agg(F.min(F.struct("_l", *cols)).alias("m")).select("query_id", *[F.col(f"m.{c}").alias(c) for c in cols])


def with_labels(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """queries with the group of their label; a query without one fails when it is read."""
    at = queries.join(labels.select("query_id", "group"), "query_id", "left")
    return at.withColumn("group", F.coalesce("group", F.raise_error(F.concat(F.lit("no label for "), "query_id")).cast("string")))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(uid, type, path, position) of an upload list: three comma-separated fields, a header line is skipped."""
    rows = _numbered(spark, path).withColumn("f", split_fields("value")).filter((trim_field("value") != "") & ~((F.col("f")[0] == "uid") & (F.col("f")[1] == "type")))
    rows = _checked(rows, F.size("f") != 3, "bad upload line")
    return _positions(rows.select(F.col("f")[0].alias("uid"), F.col("f")[1].alias("type"), F.col("f")[2].alias("path"), *LINES), "position")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, length) of all files below root, paths relative with /."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = Path(root).resolve().as_uri().replace("file://", "file:")
    return rows.select(F.regexp_replace("path", "^" + base.rstrip("/") + "/", "").alias("path"), "content", "length")


def read_maildir(spark: SparkSession, root: str, expected: int | None = None) -> DataFrame:
    """(id, mailbox, path, body) of a mail folder: ids by sorted path; files directly below root, mails without a blank line and
    another number than expected fail."""
    rows = read_files(spark, root)
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"{n} mails, {expected} expected")
    flat = rows.filter(~F.contains("path", F.lit("/"))).select("path").take(1)
    if flat:
        raise ValueError(f"a mail outside of a mailbox: {flat[0]['path']}")
    body = extract_body(F.decode("content", "ISO-8859-1"))
    rows = rows.withColumn("body", F.coalesce(body, F.raise_error(F.concat(F.lit("no blank line in "), "path")).cast("string")))
    rows = with_positions(rows.select("path", "body"), ["path"], "_n")
    return rows.select(F.format_string("mail_%06d", F.col("_n") + 1).alias("id"), F.substring_index("path", "/", 1).alias("mailbox"), "path", "body")


def read_metadata(spark: SparkSession, path: str, required: tuple[str, ...] = (), numbers: tuple[str, ...] = ()) -> DataFrame:
    """(line, meta map, typed map) of lines of name=value pairs; a required name that is missing fails.

    typed has each value as a whole number, a real number or text (text.typed_value). With numbers, only these names are kept,
    and one of them that is no whole number fails.
    """
    rows = _numbered(spark, path).filter("value <> ''").withColumn("meta", metadata_line("value"))
    for name in required:
        rows = _checked(rows, ~F.map_contains_key("meta", name), f"no {name}")
    if numbers:
        rows = rows.withColumn("meta", F.map_filter("meta", lambda k, v: k.isin(*numbers)))
        rows = _checked(rows, F.exists(F.map_values("meta"), lambda v: v.try_cast("bigint").isNull()), "not a whole number")
    return _positions(rows.select("meta", F.transform_values("meta", lambda k, v: typed_value(v)).alias("typed"), *LINES), "line")


def read_object(path: str) -> dict:
    """A JSON file that must hold an object."""
    got = json.loads(Path(path).read_text("utf-8"))
    if not isinstance(got, dict):
        raise ValueError(f"{path} holds no object")
    return got


def with_threshold(files: dict[int, DataFrame]) -> DataFrame:
    """The union of result files, each with its threshold as a column."""
    out = None
    for t, df in files.items():
        one = df.withColumn("threshold", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out
