"""The tables of the tag store, read by the rules for repeated, dirty and unreadable fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hamloom.functions.keys import hex256, norm_name, tag_bytes_hex
from hamloom.session import table


def record_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, type, tag): one row per record of tags and records; tag is null if neither has a readable one.

    The tag is the readable one of tags.tag_hex and records.tag, the type that of records (that of tags where
    records has none). Rows that repeat a record_id count once. Both tables are brought together by one aggregate.
    """
    tags = table(spark, sf_dir, "tags").select("record_id", F.lit(None).cast("string").alias("rtype"), norm_name("type").alias("ttype"), hex256("tag_hex").alias("tag"))
    records = table(spark, sf_dir, "records").select("record_id", norm_name("type").alias("rtype"), F.lit(None).cast("string").alias("ttype"), tag_bytes_hex("tag").alias("tag"))
    one = tags.unionByName(records).filter("record_id is not null").groupBy("record_id").agg(F.max("rtype").alias("rtype"), F.max("ttype").alias("ttype"), F.max("tag").alias("tag"))
    return one.select("record_id", F.coalesce("rtype", "ttype").alias("type"), "tag")


def distinct_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(type, tag, record_id, n): every distinct tag of a type, its smallest record_id and its number of records."""
    return record_tags(spark, sf_dir).filter("tag is not null and type is not null").groupBy("type", "tag").agg(F.min("record_id").alias("record_id"), F.count(F.lit(1)).alias("n"))


def manifest_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, split_id, role, digest): one row per manifest record; digest is null if unreadable."""
    m = table(spark, sf_dir, "manifest").select("id", "split_id", norm_name("split_role").alias("role"), hex256("body_sha256").alias("digest"))
    return m.groupBy("id").agg(F.max("split_id").alias("split_id"), F.max("role").alias("role"), F.max("digest").alias("digest"))
