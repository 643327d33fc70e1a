"""Counts, distributions and summaries of corpora and measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def duplicate_bucket(n: Column) -> Column:
    """The size class of a group of copies."""
    return F.when(n == 1, "1").when(n == 2, "2").when(n <= 10, "3_10").when(n <= 100, "11_100").otherwise("over_100")


def half_even_index(n: Column, q: float) -> Column:
    """round((n - 1) q) with halves to even, from 0."""
    return F.rint((n - 1) * F.lit(q)).cast("bigint")


def ceil_index(n: Column, q: str) -> Column:
    """ceil(n q) - 1, at least 0, in exact decimals."""
    return F.greatest(F.ceil(n.cast("decimal(20,0)") * F.lit(q).cast("decimal(4,3)")).cast("bigint") - 1, F.lit(0).cast("bigint"))


def order_statistics(df: DataFrame, groups: list[str], value: str, at: dict[str, Column]) -> DataFrame:
    """(*groups, n, one column per name in at): the value at a position from 0, an expression of n, of the sorted group.

    Equal values are first counted, so what is sorted per group is its distinct values, not its rows. Null values are left out.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_c"))
    by = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    run = counts.withColumn("_to", F.sum("_c").over(by.orderBy(value))).withColumn("n", F.sum("_c").over(by))
    hits = [F.max(F.when((pos < F.col("_to")) & (pos >= F.col("_to") - F.col("_c")), F.col(value))).alias(name) for name, pos in at.items()]
    return run.groupBy(*groups).agg(F.max("n").alias("n"), *hits)


def duplicate_counts(df: DataFrame, key: str) -> DataFrame:
    """(records, distinct, extra_copies, duplicate_groups) over the non-null keys."""
    per = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count(F.lit(1)).alias("distinct_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_copies"), F.count_if(F.col("n") > 1).alias("duplicate_groups"))


def duplicate_distribution(df: DataFrame, key: str) -> DataFrame:
    """One row: groups, largest, p50, p95, p99 (index round((n - 1) q), halves to even) and the number in each size class."""
    per = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    n = F.col("n")
    mid = order_statistics(per, [], "copies", {name: half_even_index(n, q) for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))})
    classes = per.agg(F.max("copies").alias("largest"), *[F.count_if(duplicate_bucket(F.col("copies")) == b).alias(f"groups_{b}") for b in ("1", "2", "3_10", "11_100", "over_100")])
    return mid.withColumnRenamed("n", "groups").join(classes, F.lit(True))  # one row each


def summarise(rows: DataFrame, scheme: str, threshold: str, group: str, query: str, latency: str, matched: Column, means: list[str]) -> DataFrame:
    """By scheme and threshold, for all groups and for each: samples, queries, matched rate, latency statistics and means.

    One pass with grouping sets; group is "all" where it is summed up. The median is the middle of the two middle values of
    an even number; p95 has the index round(0.95 (n - 1)), halves to even. Means leave nulls out.
    """
    base = rows.select(F.col(scheme).alias("scheme"), F.col(threshold).alias("threshold"), F.col(group).alias("grp"), F.col(query).alias("query_id"), F.col(latency).cast("double").alias("latency"), matched.cast("double").alias("matched"), *means)
    base = base.filter("grp is not null")
    both = base.withColumn("grp", F.explode(F.array(F.lit("all"), F.col("grp"))))
    n = F.col("n")
    keys = ["scheme", "threshold", "grp"]
    mid = order_statistics(both.select(*keys, "latency"), keys, "latency", {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2), "p95_latency": half_even_index(n, 0.95)})
    view = base.groupingSets([[F.col("scheme"), F.col("threshold")], [F.col("scheme"), F.col("threshold"), F.col("grp")]], "scheme", "threshold", "grp")
    agg = view.agg(F.count(F.lit(1)).alias("samples"), F.countDistinct("query_id").alias("queries"), F.round(F.avg("matched"), 6).alias("matched_rate"), F.round(F.avg("latency"), 4).alias("mean_latency"), *[F.round(F.avg(m), 4).alias(f"mean_{m}") for m in means])
    agg = agg.withColumn("grp", F.coalesce("grp", F.lit("all")))
    stat = mid.select(*keys, ((F.col("low") + F.col("high")) / 2).alias("median_latency"), "p95_latency")
    return agg.join(stat, keys, "left").withColumnRenamed("grp", "group")


def tail_summary(rows: DataFrame, groups: list[str], metric: str) -> DataFrame:
    """(*groups, metric, samples, mean, p50, p95, p99, largest) of a metric; percentiles have the index ceil(n q) - 1."""
    n = F.col("n")
    mid = order_statistics(rows, groups, metric, {name: ceil_index(n, q) for name, q in (("p50", "0.5"), ("p95", "0.95"), ("p99", "0.99"))})
    rest = rows.filter(F.col(metric).isNotNull()).groupBy(*groups).agg(F.round(F.avg(metric), 4).alias("mean"), F.max(metric).alias("largest"))
    out = mid.join(rest, groups)
    return out.select(*groups, F.lit(metric).alias("metric"), F.col("n").alias("samples"), "mean", "p50", "p95", "p99", "largest")


def scale_comparison(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both summaries (*keys, mean_latency, matched_rate): the latency ratio, null for 0, and the rate's change."""
    a, b = new.alias("a"), old.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return a.join(b, cond).select(*[F.col(f"a.{k}") for k in keys], F.round(F.when(F.col("b.mean_latency") != 0, F.col("a.mean_latency") / F.col("b.mean_latency")), 6).alias("latency_ratio"), F.round(F.col("a.matched_rate") - F.col("b.matched_rate"), 6).alias("matched_rate_delta"))


def agreement(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(metric, pairs, equal, equal_rate, mean_a, mean_b, only_a, only_b) of two runs with the same keys."""
    left, right = a.alias("a"), b.alias("b")
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    both = left.join(right, cond, "full_outer")
    k = keys[0]
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a.{m}").cast("double").alias("x"), F.col(f"b.{m}").cast("double").alias("y")) for m in metrics])
    rows = both.select(F.col(f"a.{k}").isNotNull().alias("ina"), F.col(f"b.{k}").isNotNull().alias("inb"), F.explode(each).alias("m")).select("ina", "inb", "m.*")
    pair = F.col("ina") & F.col("inb")
    return rows.groupBy("metric").agg(F.count_if(pair).alias("pairs"), F.count_if(pair & F.col("x").eqNullSafe(F.col("y"))).alias("equal"), F.round(F.avg(F.when(pair, F.col("x").eqNullSafe(F.col("y")).cast("int"))), 6).alias("equal_rate"), F.round(F.avg(F.when(pair, F.col("x"))), 4).alias("mean_a"), F.round(F.avg(F.when(pair, F.col("y"))), 4).alias("mean_b"), F.count_if(~F.col("inb")).alias("only_a"), F.count_if(~F.col("ina")).alias("only_b"))


def strategy_summary(rows: DataFrame, strategy: str, latency: str, metrics: list[str]) -> DataFrame:
    """(strategy, samples, mean_latency, p95_latency, mean_<metric> and total_<metric> of every metric), and a row "all" for all strategies.

    p95 has the index ceil(0.95 n) - 1. Null latencies count in nothing.
    """
    both = rows.filter(F.col(latency).isNotNull()).select(F.explode(F.array(F.col(strategy), F.lit("all"))).alias("strategy"), F.col(latency).alias("latency"), *metrics)
    mid = order_statistics(both.select("strategy", "latency"), ["strategy"], "latency", {"p95_latency": ceil_index(F.col("n"), "0.95")}).drop("n")
    sums = [x for m in metrics for x in (F.round(F.avg(m), 4).alias(f"mean_{m}"), F.sum(m).alias(f"total_{m}"))]
    return both.groupBy("strategy").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("latency"), 4).alias("mean_latency"), *sums).join(mid, "strategy")


def run_comparison(a: DataFrame, b: DataFrame, keys: list[str], latency: str, metrics: list[str]) -> DataFrame:
    """One row per key (unique in either) that both runs have: whether each matched, whether candidates and all counters agree,
    both latencies, and of every counter both values and their difference. metrics[0] is the number of candidates."""
    left, right = a.alias("a"), b.alias("b")
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    same = [F.col(f"a.{m}").eqNullSafe(F.col(f"b.{m}")) for m in metrics]
    every = same[0]
    for x in same[1:]:
        every = every & x
    found = [(F.col(f"{x}.{metrics[0]}") > 0).cast("int").alias(f"{x}_matched") for x in "ab"]
    values = [c for m in metrics for c in (F.col(f"a.{m}").alias(f"a_{m}"), F.col(f"b.{m}").alias(f"b_{m}"), (F.col(f"a.{m}") - F.col(f"b.{m}")).alias(f"delta_{m}"))]
    return left.join(right, cond).select(*[F.col(f"a.{k}") for k in keys], *found, same[0].cast("int").alias("candidate_match"), every.cast("int").alias("workload_match"), F.col(f"a.{latency}").alias("a_latency"), F.col(f"b.{latency}").alias("b_latency"), *values)


def latency_comparison(a: DataFrame, b: DataFrame, keys: list[str], latency: str) -> DataFrame:
    """(*keys, samples, and mean, median and p95 of either run, mean_delta, mean_ratio): the latencies of two runs by key.

    Medians are the middle of the two middle values of an even number; p95 has the index ceil(0.95 n) - 1. The ratio is null for 0.
    """
    n = F.col("n")
    sides = []
    for name, df in (("a", a), ("b", b)):
        mid = order_statistics(df, keys, latency, {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2), "p95": ceil_index(n, "0.95")})
        mean = df.filter(F.col(latency).isNotNull()).groupBy(*keys).agg(F.avg(latency).alias("mean"))
        sides.append(mid.join(mean, keys).select(*keys, n.alias(f"{name}_samples"), F.col("mean").alias(f"{name}_mean"), ((F.col("low") + F.col("high")) / 2).alias(f"{name}_median"), F.col("p95").alias(f"{name}_p95")))
    both = sides[0].join(sides[1], keys)
    ratio = F.when(F.col("b_mean") != 0, F.col("a_mean") / F.col("b_mean"))
    return both.withColumns({"mean_delta": F.round(F.col("a_mean") - F.col("b_mean"), 6), "mean_ratio": F.round(ratio, 6), "a_mean": F.round("a_mean", 6), "b_mean": F.round("b_mean", 6)})


def rotation(index: Column, repeat: Column, offset: Column, k: int) -> Column:
    """Which of k thresholds comes at an offset for a query and repeat: the order turns, so none is always first."""
    return F.pmod(index + repeat + offset, F.lit(k))
