"""Counts and shares of every key when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hamloom.functions.keys import hex256
from hamloom.session import table


def key_shares(df: DataFrame, key: str, hot_share: float | None = None) -> DataFrame:
    """(key, n, total, share) of every non-null key; only those with at least hot_share of the rows if given.

    The count is an algebraic aggregate: each task combines its rows in a bounded hash table that spills, and
    only one row per key and task is shuffled, so a key that holds a third of the rows costs no more than others.
    Null keys count neither as keys nor in the total. An empty table gives no row.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    out = counts.withColumn("total", counts.select(F.sum("n")).scalar())
    out = out.withColumn("share", F.col("n") / F.col("total"))
    return out if hot_share is None else out.filter(F.col("n") >= F.col("total") * F.lit(hot_share).cast("decimal(16,12)"))


def once_per(df: DataFrame, ids: list[str], value: str) -> DataFrame:
    """One row per ids; of repeated rows the largest non-null value."""
    return df.groupBy(*ids).agg(F.max(value).alias(value))


def body_keys(spark, sf_dir: str) -> DataFrame:
    """One row per manifest record with its readable digest or null."""
    rows = table(spark, sf_dir, "manifest").select("id", hex256("body_sha256").alias("key_hex"))
    return once_per(rows, ["id"], "key_hex")


def posting_keys(spark, sf_dir: str) -> DataFrame:
    """One row per distinct posting with the hex digits of its value."""
    return table(spark, sf_dir, "postings").select("type", "segment", "value", "record_id").distinct().select(F.lower(F.hex("value")).alias("key_hex"))


def p5_shares(spark, sf_dir: str) -> DataFrame:
    """Count and share of every body digest and posting value."""
    parts = [key_shares(d, "key_hex").select(F.lit(kind).alias("key_kind"), "key_hex", "n", F.round("share", 9).alias("share")) for kind, d in (("body", body_keys(spark, sf_dir)), ("posting", posting_keys(spark, sf_dir)))]
    return parts[0].unionByName(parts[1])


def p5_found(spark, sf_dir: str, body_share: float = 0.01, posting_share: float = 0.0027) -> DataFrame:
    """The keys that hold at least the given share of the records or postings."""
    body = key_shares(body_keys(spark, sf_dir), "key_hex", body_share)
    posting = key_shares(posting_keys(spark, sf_dir), "key_hex", posting_share)
    return body.select(F.lit("body").alias("key_kind"), "key_hex").unionByName(posting.select(F.lit("posting").alias("key_kind"), "key_hex"))
