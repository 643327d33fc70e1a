"""Splits, labels and stratified samples of a corpus."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hamloom.operators.skew import lookup_unique, ranked
from hamloom.session import materialise


def hash_order(seed: int, ident: Column) -> Column:
    """A bigint that orders ids at random but the same for a seed."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}/"), ident), 256), 1, 16), 16, -10).cast("bigint")


def split(records: DataFrame, ident: str, size: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(query pool, reference): `size` records in hash order, and all others."""
    at = ranked(records.withColumn("_h", hash_order(seed, F.col(ident))).withColumn("_all", F.lit(0)), ["_all"], ["_h", ident]).drop("n_rank", "_all", "_h")
    return at.filter(F.col("rank") <= size).drop("rank"), at.filter(F.col("rank") > size).drop("rank")


def exact_sample(ids: Sequence[str], size: int, seed: int) -> list[str]:
    """A sample that repeats a seeded generator over sorted ids exactly; for populations that fit the driver."""
    return sorted(random.Random(seed).sample(sorted(ids), size))


def exact_ref(pool: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """pool with `group`: exact_ref if its key occurs in reference, otherwise no_exact_ref (also for a null key).

    Keys that many rows of the pool have are looked up by broadcast, the others by shuffle (see lookup_unique).
    """
    known = materialise(reference.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_known", F.lit(True)))
    counts = materialise(pool.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    return lookup_unique(pool, known, [key], counts).withColumn("group", F.when(F.col("_known"), "exact_ref").otherwise("no_exact_ref")).drop("_known")


def largest_remainder(counts: DataFrame, total: int) -> DataFrame:
    """(group, n, seats): `total` seats in proportion to n; whole shares first, the rest by the largest fraction, then name.

    counts has (group, n), one row per group. Shares are exact decimals.
    """
    share = F.col("n").cast("decimal(18,0)") * F.lit(total).cast("decimal(18,0)") / F.sum("n").over(W.partitionBy(F.lit(0))).cast("decimal(18,0)")
    at = counts.withColumn("_share", share).withColumn("_whole", F.floor("_share"))
    left = F.lit(total) - F.sum("_whole").over(W.partitionBy(F.lit(0)))
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy((F.col("_share") - F.col("_whole")).desc(), F.col("group")))
    return at.withColumn("_left", left).withColumn("_rank", rank).select("group", "n", (F.col("_whole") + (F.col("_rank") <= F.col("_left")).cast("int")).cast("bigint").alias("seats"))


def stratified(pool: DataFrame, ident: str, total: int, seed: int, verify: int = 1) -> tuple[DataFrame, DataFrame]:
    """(benchmark, verify) of a pool with `group`: seats by largest_remainder, records in hash order; `verify` records of every
    group are drawn on their own and may be in both."""
    seats = largest_remainder(pool.groupBy("group").agg(F.count(F.lit(1)).alias("n")), total).select("group", "seats")
    first = ranked(pool.withColumn("_h", hash_order(seed, F.col(ident))), ["group"], ["_h", ident])
    second = ranked(pool.withColumn("_h", hash_order(seed + 1, F.col(ident))), ["group"], ["_h", ident])
    drop = ["_h", "rank", "n_rank"]
    return first.join(F.broadcast(seats), "group").filter(F.col("rank") <= F.col("seats")).drop("seats", *drop), second.filter(F.col("rank") <= verify).drop(*drop)
