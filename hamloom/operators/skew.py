"""Building blocks that keep hot keys from ending in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hamloom.session import materialise

#: A key is hot if it has at least this share of the rows: so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001


def null_safe(a: DataFrame, b: DataFrame, keys: list[str], la: str, lb: str) -> Column:
    """a.keys <=> b.keys for frames aliased la and lb."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{la}.{k}").eqNullSafe(F.col(f"{lb}.{k}"))
    return out


def lookup_unique(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, how: str = "left") -> DataFrame:
    """Join left to right, which has one row per key, without sending a hot key's rows to one task.

    counts has the keys and n, their rows in left. The right rows of hot keys, at most 1 / HOT_SHARE by
    definition, are broadcast; all other rows go through an ordinary shuffled join. Null keys match nothing.
    """
    total = counts.select(F.sum("n")).scalar()
    hot = counts.filter(F.col("n") >= total * HOT_SHARE).select(*keys)
    extra = [c for c in right.columns if c not in keys]
    marked = F.broadcast(hot.join(right, keys, "left").withColumn("_hot", F.lit(True)))
    at = left.join(marked, keys, "left")
    first = at.filter("_hot").drop("_hot")
    rest = at.filter("_hot is null").drop("_hot", *extra).join(right, keys, how)
    if how == "inner":
        first = first.join(F.broadcast(hot.join(right.select(*keys), keys, "left_semi")), keys, "left_semi")
    return first.unionByName(rest)


def spread(df: DataFrame, groups: list[str], order: list[str | Column], buckets: int, value: Column, name: str) -> DataFrame:
    """Add the exclusive running sum of `value` within `groups` in the order of `order`, and n_<name>, the group's total.

    order[0] is a bigint, uniform over its range (a hash). Its top bits cut every group into `buckets` ranges (a power
    of two); only a table of bucket sums is accumulated per group, and the rows within a bucket in their own task.
    """
    first = order[0] if isinstance(order[0], Column) else F.col(order[0])
    df = df.withColumn("_b", F.shiftright(first, 64 - (buckets - 1).bit_length()))
    sums = df.groupBy(*groups, "_b").agg(F.sum(value).alias("_s"))
    by = W.partitionBy(*groups)
    before = sums.withColumns({"_before": F.coalesce(F.sum("_s").over(by.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), f"n_{name}": F.sum("_s").over(by)}).drop("_s")
    inner = W.partitionBy(*groups, "_b").orderBy(*order)
    rows = df.withColumn("_in", F.coalesce(F.sum(value).over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    keys = [*groups, "_b"]
    joined = rows.alias("l").join(before.alias("r"), null_safe(rows, before, keys, "l", "r"))
    return joined.select("l.*", "r._before", f"r.n_{name}").withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before", "_b")


def with_positions(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Add the numbers from 0 of the rows in the given order: range partitions, their sizes, and places within them.

    Rows that are equal in all of `order` get neighbouring numbers in any order. The numbered rows are a written table.
    """
    spark = df.sparkSession
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the number's upper bits are the partition's, its lower 33 the place within it
    numbered = materialise(cut.withColumn("_at", F.monotonically_increasing_id()))
    return _placed(spark, numbered, name)


def _placed(spark: SparkSession, numbered: DataFrame, name: str) -> DataFrame:
    """Turn _at, partition and place of written rows, into numbers from 0."""
    part = F.shiftright("_at", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per partition
    offset, starts = 0, {}
    for r in sorted(sizes, key=lambda r: r["_part"]):
        starts[r["_part"]], offset = offset, offset + r["n"]
    if not starts:
        return numbered.drop("_at").withColumn(name, F.lit(0).cast("bigint"))
    first = spark.createDataFrame(list(starts.items()), "_part bigint, _first bigint")
    return numbered.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_first")


def ranked(df: DataFrame, groups: list[str], order: list[str | Column], buckets: int = 64, name: str = "rank") -> DataFrame:
    """Row numbers from 1 within groups in the order of `order` (see spread), and n_<name>, the group's rows."""
    return spread(df, groups, order, buckets, F.lit(1).cast("bigint"), name).withColumn(name, F.col(name) + 1)
