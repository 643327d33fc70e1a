"""Samples whose categories match target proportions, by divisor-method priorities."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hamloom.operators.store import manifest_once
from hamloom.operators.skew import lookup_unique, null_safe, ranked
from hamloom.session import materialise, table

#: Records of one category are ranked in this many hash ranges, each in its own task.
BUCKETS = 64


def seats(available: list[int], target: list[float], floor: list[int], total: int) -> list[int]:
    """How many records of each category are drawn: floors first, then the smallest (rank - 0.5) / target.

    A category gives no more than it has; the seats of an exhausted one go to the next smallest priorities of the
    others. A category with target 0 gets its floor only. Equal priorities are settled by position. A bisection over
    the priority finds all seats but the last few; a heap hands out those.
    """
    low = [min(a, f) for a, f in zip(available, floor, strict=True)]

    def drawn(limit: float) -> list[int]:
        return [max(lo, min(a, int(limit * t + 0.5))) if t > 0 else lo for lo, a, t in zip(low, available, target, strict=True)]

    if sum(low) >= total:
        return low
    at, below, above = low, 0.0, max([0.0, *((a + 1) / t for a, t in zip(available, target, strict=True) if t > 0)])
    for _ in range(60):
        middle = (below + above) / 2
        if sum(now := drawn(middle)) <= total:
            at, below = now, middle
        else:
            above = middle
    out = list(at)
    heap = [((out[i] + 0.5) / t, i) for i, t in enumerate(target) if t > 0 and out[i] < available[i]]
    heapq.heapify(heap)
    for _ in range(total - sum(out)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < available[i]:
            heapq.heappush(heap, ((out[i] + 0.5) / target[i], i))
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def _allocate(available: pd.Series, target: pd.Series, floor: pd.Series, total: pd.Series) -> pd.Series:
    """The seats of each group from lists with one entry per category."""
    return pd.Series([seats(list(map(int, a)), list(map(float, t)), list(map(int, f)), int(n)) for a, t, f, n in zip(available, target, floor, total, strict=True)])


def proportional_sample(records: DataFrame, targets: DataFrame, seed: str = "0") -> tuple[DataFrame, DataFrame]:
    """(sample, report) of records (grp, category, id) for targets (grp, category, target, floor, seed).

    A group draws sum(max(target, floor)) records: at least `floor` of each category, the rest by the smallest
    priorities (rank - 0.5) / target with random ranks within a category. report has one row per row of targets:
    (grp, category, available, target, floor, drawn, short); drawn counts the rows of the sample, and short is true where
    they are fewer than the larger of target and floor. sample has (grp, category, id, rank). Null targets and floors are 0. Records
    with a null category or of a group without targets are in no sample. Only counts decide the seats, so no task
    sees a group's records; ranks come from hash ranges (see operators.skew.ranked), so a category may hold any
    share of the rows. Repeated targets of a category count once; equal ids are ranked in any order.
    """
    at = targets.groupBy("grp", "category").agg(F.coalesce(F.max("target"), F.lit(0)).cast("double").alias("target"), F.coalesce(F.max("floor"), F.lit(0)).cast("bigint").alias("floor"), F.max("seed").alias("seed") if "seed" in targets.columns else F.lit(seed).alias("seed"))
    rows = records.filter("category is not null").select("grp", "category", "id")
    counts = rows.groupBy("grp", "category").agg(F.count(F.lit(1)).alias("available"))
    need = F.greatest(F.col("target"), F.col("floor").cast("double"))
    plan = at.alias("l").join(counts.alias("r"), null_safe(at, counts, ["grp", "category"], "l", "r"), "left").select("l.*", F.coalesce("r.available", F.lit(0)).cast("bigint").alias("available"))
    totals = at.groupBy("grp").agg(F.sum(F.ceil(need)).cast("bigint").alias("total"))
    plan = plan.alias("l").join(totals.alias("r"), F.col("l.grp").eqNullSafe(F.col("r.grp"))).select("l.*", "r.total")
    # a list per group with one entry per category, so that many groups share an Arrow batch
    cols = ["category", "available", "target", "floor", "seed"]
    lists = plan.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("c"), F.max("total").alias("total"))
    lists = lists.withColumn("drawn", _allocate("c.available", "c.target", "c.floor", "total"))
    plan = lists.select("grp", F.explode(F.arrays_zip("c", "drawn")).alias("z")).select("grp", "z.c.*", "z.drawn")
    plan = materialise(plan)  # one row per group and category
    drawn = plan.filter("drawn > 0").select("grp", "category", "drawn", "seed")
    mine = rows.alias("l").join(drawn.alias("r"), null_safe(rows, drawn, ["grp", "category"], "l", "r")).select("l.*", "r.drawn", "r.seed")
    mine = mine.withColumn("_h", random_order(F.col("seed"), F.col("id")))
    sample = ranked(mine, ["grp", "category"], ["_h", "id"], BUCKETS).filter("rank <= drawn").select("grp", "category", "id", "rank")
    got = sample.groupBy("grp", "category").agg(F.count(F.lit(1)).alias("got"))
    both = plan.alias("l").join(got.alias("r"), null_safe(plan, got, ["grp", "category"], "l", "r"), "left").select("l.*", F.coalesce("r.got", F.lit(0)).alias("got"))
    report = both.select("grp", "category", "available", "target", "floor", F.col("got").alias("drawn"), (F.col("got") < need).alias("short"))
    return sample, report


def random_order(seed: Column, ident: Column) -> Column:
    """A bigint that orders ids at random but the same for a seed: the first 64 bits of SHA-256 over seed, a slash and id."""
    return F.conv(F.substring(F.sha2(F.concat(F.coalesce(seed.cast("string"), F.lit("")), F.lit("/"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"), 256), 1, 16), 16, -10).cast("bigint")


def pool_records(spark, sf_dir: str) -> DataFrame:
    """(grp, category, id) of the query pool: exact_ref if a reference record has the same digest.

    A handful of digests hold half of the records: these are looked up by broadcast (lookup_unique).
    """
    m = materialise(manifest_once(spark, sf_dir).filter("digest is not null"))
    known = materialise(m.filter("role = 'reference'").select("digest").distinct().withColumn("known", F.lit(True)))
    rows = m.filter("role = 'query_pool'")
    pool = lookup_unique(rows, known, ["digest"], materialise(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))))
    return pool.select(F.col("split_id").alias("grp"), F.when(F.col("known"), "exact_ref").otherwise("no_exact_ref").alias("category"), "id")


def split_targets(spark, sf_dir: str) -> DataFrame:
    """(grp, category, target, floor, seed) of every split and both categories; of repeated rows the largest values count."""
    each: Iterable[str] = ("exact_ref", "no_exact_ref")
    of = [F.max(f"{g}.{c}").alias(f"{g}_{c}") for g in ("benchmark_groups", "verify_groups") for c in each]
    s = table(spark, sf_dir, "split_summary").groupBy(F.col("split_id").alias("grp")).agg(F.max("sample_seed").cast("string").alias("seed"), *of)
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"benchmark_groups_{c}").alias("target"), F.col(f"verify_groups_{c}").alias("floor")) for c in each])
    return s.select("grp", F.explode(pairs).alias("p"), "seed").select("grp", "p.*", "seed")


def p4_sample(spark, sf_dir: str) -> DataFrame:
    """The sample of every split."""
    sample, _ = proportional_sample(pool_records(spark, sf_dir), split_targets(spark, sf_dir))
    return sample.select(F.col("grp").alias("split_id"), "category", "id")


def p4_report(spark, sf_dir: str) -> DataFrame:
    """Available, wanted and drawn records of every split and category."""
    _, report = proportional_sample(pool_records(spark, sf_dir), split_targets(spark, sf_dir))
    return report.select(F.col("grp").alias("split_id"), "category", "available", F.col("target").cast("bigint").alias("target"), "floor", "drawn", "short")


def p4_found(spark, sf_dir: str) -> DataFrame:
    """Categories of a split whose sample falls short because the pool has fewer records than asked for."""
    _, report = proportional_sample(pool_records(spark, sf_dir), split_targets(spark, sf_dir))
    return report.filter("short").select(F.col("grp").alias("split_id"), "category")
