"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hamloom.session import drop_dir, materialise, shared_dir


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b); component is its smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), which contract a chain of n links in
    O(log n) rounds or so. A round takes two aggregates by node; no task holds a node's neighbours. The links of each
    round are written to the shared folder, so a lost executor costs no more than its part of the current round.
    Loops and repeated links are allowed; null ends are ignored; an empty table gives no row.
    """
    spark = links.sparkSession
    kept: list[str] = []

    def save(df: DataFrame) -> DataFrame:
        kept.append(shared_dir(spark))
        out = materialise(df, kept[-1])
        if len(kept) > 2:
            drop_dir(spark, kept.pop(0))
        return out

    edges = save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and u <> v").distinct())
    for _ in range(max_rounds):
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = save(small)
        same = new.select(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
        old = edges.select(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
        a, b = same.union(old).collect()
        edges = new
        if a == b:
            break
    else:
        raise RuntimeError(f"links did not contract in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    return out
