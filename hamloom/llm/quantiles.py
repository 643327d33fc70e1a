"""Percentiles per group by radix selection over order-preserving integers."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from hamloom.functions.keys import norm_name
from hamloom.operators.skew import null_safe
from hamloom.session import materialise, table

#: At most this many selection targets (rows of a few numbers) are broadcast to the next pass.
BROADCAST_TARGETS = 200_000
SALTS = 16


def order_key(c: Column, kind: T.DataType) -> Column:
    """A 64-bit integer whose order is that of the number c; NaN counts as null.

    Integers are their own key. Of floating values the IEEE bits are taken; for negative ones all bits but the
    sign are inverted. -0.0 equals 0.0. Runs in the JVM.
    """
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("bigint")
    d = F.when(~F.isnan(c.cast("double")), c.cast("double") + F.lit(0.0))
    bits = F.when(d.isNotNull(), F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), d)).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1).cast("bigint")))


def key_value(k: Column, kind: T.DataType) -> Column:
    """The number of an order key."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return k
    bits = F.when(k >= 0, k).otherwise(k.bitwiseXOR(F.lit((1 << 63) - 1).cast("bigint")))
    return F.when(k.isNotNull(), F.call_function("java_method", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits)).cast("double")


def _rank(q: str, n: Column) -> Column:
    """ceil(q n), at least 1, in whole numbers."""
    f = Fraction(q)
    num, den = F.lit(f.numerator).cast("decimal(18,0)"), F.lit(f.denominator).cast("decimal(18,0)")
    return F.greatest(F.ceil(n.cast("decimal(18,0)") * num / den).cast("bigint"), F.lit(1).cast("bigint"))


def label(q: str) -> str:
    """The column of quantile q: p50 for "0.5", p99_9 for "0.999"."""
    x = Fraction(q) * 100
    return f"p{x.numerator}" if x.denominator == 1 else "p" + str(float(x)).replace(".", "_")


def radix_state(df: DataFrame, groups: list[str], value: str, bits: int = 20) -> DataFrame:
    """A mergeable summary: (*groups, bucket, n), bucket being the upper `bits` bits of the order key.

    States of days or partitions are combined with merge_states. With b bits of a floating value, percentiles are
    known within a relative error of 2^(12-b) (12 bits are sign and exponent).
    """
    key = order_key(F.col(value), df.schema[value].dataType)
    return df.withColumn("bucket", F.shiftright(key, 64 - bits)).filter("bucket is not null").groupBy(*groups, "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all rows of the given states. Rows in several states count in each; day_states makes states in which
    a measurement that is reported again counts once."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    groups = [c for c in both.columns if c not in ("bucket", "n")]
    return both.groupBy(*groups, "bucket").agg(F.sum("n").alias("n")).filter("n <> 0")


def state_percentiles(state: DataFrame, groups: list[str], quantiles: list[str], bits: int = 20) -> DataFrame:
    """(*groups, n, q, low, high): the nearest-rank percentile of each group lies between low and high."""
    by = W.partitionBy(*groups)
    at = state.withColumns({"_to": F.sum("n").over(by.orderBy("bucket")), "_n": F.sum("n").over(by)})
    hit = F.array(*[F.struct(F.lit(q).alias("q"), _rank(q, F.col("_n")).alias("r")) for q in quantiles])
    rows = at.withColumn("t", F.explode(hit)).filter("t.r <= _to and t.r > _to - n")
    low, width = F.shiftleft(F.col("bucket"), 64 - bits), (1 << (64 - bits)) - 1
    double = T.DoubleType()
    return rows.select(*groups, F.col("_n").alias("n"), F.col("t.q").alias("q"), key_value(low, double).alias("low"), key_value(low + F.lit(width).cast("bigint"), double).alias("high"))


def value_changes(reports: DataFrame, groups: list[str], ids: list[str], day: str, value: str) -> DataFrame:
    """(*groups, day, key, old, last): the reports that change a measurement's value, in order of their days.

    A measurement is named by groups and ids and may be reported any number of times, on any days; the largest value
    counts. key and old are order keys (order_key) of the value from that day on and of the one before, null on the first day;
    last is true for the value that holds in the end. Null and NaN values change nothing. Reports are first brought
    down to one per measurement and day where they lie, so a measurement that is reported very often has no more rows than days.
    """
    key = order_key(F.col(value).cast("double"), T.DoubleType())
    per = reports.select(*groups, *ids, day, key.alias("key")).filter("key is not null").groupBy(*groups, *ids, day).agg(F.max("key").alias("key"))
    by = W.partitionBy(*groups, *ids)
    before = F.max("key").over(by.orderBy(day).rowsBetween(W.unboundedPreceding, -1))
    at = per.withColumns({"old": before, "_top": F.max("key").over(by)}).filter("old is null or key > old")
    return at.select(*groups, day, "key", "old", (F.col("key") == F.col("_top")).alias("last"))


def day_states(changes: DataFrame, groups: list[str], day: str, bits: int = 20) -> DataFrame:
    """(*groups, day, bucket, n): one mergeable state per day from value_changes.

    A value that a later day replaces is taken out again by that day's state (n may be negative), so the sum over any
    first days is the state of all measurements as known then: none counts twice. States are made for each day by itself and
    combined by merge_states; the rows of earlier days aren't read again.
    """
    each = F.array(F.struct(F.col("key").alias("k"), F.lit(1).cast("bigint").alias("c")), F.struct(F.col("old").alias("k"), F.lit(-1).cast("bigint").alias("c")))
    rows = changes.select(*groups, day, F.explode(each).alias("e")).filter("e.k is not null").select(*groups, day, F.shiftright(F.col("e.k"), 64 - bits).alias("bucket"), "e.c")
    return rows.groupBy(*groups, day, "bucket").agg(F.sum("c").alias("n")).filter("n <> 0")


def radix_percentiles(df: DataFrame, groups: list[str], value: str, quantiles: list[str], digit_bits: int = 10) -> DataFrame:
    """(*groups, n, one column per quantile, such as p95): exact nearest-rank percentiles (sorted position ceil(q n)) of every group.

    quantiles are decimal strings such as "0.95". Each pass counts, per group, the values by their next digit_bits
    bits and keeps of every target only the digit that contains its rank; a pass shuffles at most 2^digit_bits
    counts per target and map task, never values, so a group may hold any share of the rows. Leading bits that all
    values share take no pass; later passes read only the rows that the one before left. Nulls and NaN are left out; a group
    without values gives no row; null group keys are groups of their own. Other columns of df are dropped; a group
    column may have any name but those with _.
    """
    kind = df.schema[value].dataType
    g = [f"_g{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(c).alias(a) for c, a in zip(groups, g, strict=True)], order_key(F.col(value), kind).alias("_k")).filter("_k is not null")
    return select_ranks(materialise(_salted(rows)), g, quantiles, digit_bits, kind).select(*[F.col(a).alias(c) for c, a in zip(groups, g, strict=True)], "n", *[label(q) for q in quantiles])


def _salted(rows: DataFrame) -> DataFrame:
    """rows with a number below SALTS that depends on a row's place, not its values; to be written before it is used."""
    return rows.withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))


def select_ranks(rows: DataFrame, g: list[str], quantiles: list[str], digit_bits: int, kind: T.DataType, state: DataFrame | None = None, state_bits: int = 20) -> DataFrame:
    """The passes of radix_percentiles over (*g, _k, _s), a written table.

    With state, the merged state (*g, bucket, n) of the same rows by their upper state_bits bits, the first digit is
    read from it and rows are read for the digits below only.
    """
    lo, hi = rows.select(F.min("_k"), F.max("_k")).first()
    names = [label(q) for q in quantiles]
    if lo is None:
        return rows.select(*g, F.lit(0).cast("bigint").alias("n"), *[key_value(F.col("_k"), kind).alias(c) for c in names]).limit(0)
    # the digits below the bits that lo and hi share, taken from the offset to lo's prefix
    open_bits = 64 if state is not None else (lo ^ hi).bit_length() if (lo < 0) == (hi < 0) else 64
    shift = open_bits
    prefix = F.shiftright(F.col("_k"), shift) if shift < 64 else F.lit(0).cast("bigint")
    targets = None
    while shift > 0 or targets is None:
        step = min(state_bits if state is not None and targets is None else digit_bits, shift)
        nxt = F.shiftright(F.col("_k"), shift - step)
        if targets is None:
            if state is not None:
                counted = state.select(*g, F.col("bucket").alias("_d"), F.col("n").alias("_c"))
            else:
                counted = rows.withColumn("_d", nxt).groupBy(*g, "_d").agg(F.count(F.lit(1)).alias("_c"))
            by = W.partitionBy(*g)
            at = counted.withColumns({"_to": F.sum("_c").over(by.orderBy("_d")), "n": F.sum("_c").over(by)})
            ranks = F.array(*[F.struct(F.lit(i).alias("i"), _rank(q, F.col("n")).alias("r")) for i, q in enumerate(quantiles)])
            hit = at.withColumn("_t", F.explode(ranks)).select(*g, "_d", "_c", "_to", "n", F.col("_t.i").alias("_i"), F.col("_t.r").alias("_r"))
        else:
            paths = targets.groupBy(*g, "_d").agg(F.lit(True).alias("_on"))
            keys = [*g, "_d"]
            at = rows.withColumn("_d", prefix)
            if paths.count() <= BROADCAST_TARGETS:
                on = at.alias("l").join(F.broadcast(paths).alias("r"), null_safe(at, paths, keys, "l", "r"), "left_semi")
            else:
                # the salt comes from a row's place, so a value that holds most of a group is spread like any other
                salted = paths.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
                on = at.alias("l").join(salted.alias("r"), null_safe(at, salted, [*keys, "_s"], "l", "r"), "left_semi")
            if shift > step:
                rows = materialise(on.select(*g, "_k", "_s"))
                on = rows.withColumn("_d", prefix)
            counted = on.withColumnRenamed("_d", "_p").withColumn("_d", nxt).groupBy(*g, "_p", "_d").agg(F.count(F.lit(1)).alias("_c"))
            by = W.partitionBy(*g, "_p")
            at = counted.withColumn("_to", F.sum("_c").over(by.orderBy("_d")))
            t = targets.withColumnRenamed("_d", "_p")
            hit = at.alias("l").join(t.alias("r"), null_safe(at, t, [*g, "_p"], "l", "r")).select("l.*", "r.n", "r._i", "r._r").drop("_p")
        inside = (F.col("_r") <= F.col("_to")) & (F.col("_r") > F.col("_to") - F.col("_c"))
        # a few numbers per group, target and pass
        targets = materialise(hit.filter(inside).select(*g, "_d", "n", "_i", (F.col("_r") - (F.col("_to") - F.col("_c"))).alias("_r")))
        shift -= step
        prefix = F.shiftright(F.col("_k"), shift)
    wide = targets.groupBy(*g).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("_i") == i, F.col("_d"))).alias(f"_v{i}") for i in range(len(names))])
    return wide.select(*g, "n", *[key_value(F.col(f"_v{i}"), kind).alias(c) for i, c in enumerate(names)])


MEASUREMENT = ["run_id", "strategy", "type", "query_id", "repeat"]
#: Upper bits of a latency's order key in the states of days: percentiles are known within a factor of 1 + 2^-12 from them alone.
STATE_BITS = 24


def latency_changes(spark, sf_dir: str) -> DataFrame:
    """The changes of latency_us by day over all reports of prefuzz_verify (see value_changes)."""
    t = table(spark, sf_dir, "prefuzz_verify").select("run_id", norm_name("strategy").alias("strategy"), norm_name("type").alias("type"), "query_id", "repeat", "run_day", F.when(F.col("latency_us") >= 0, F.col("latency_us")).alias("v"))
    return value_changes(t, MEASUREMENT[:3], MEASUREMENT[3:], "run_day", "v")


def p1_percentiles(spark, sf_dir: str) -> DataFrame:
    """Median and 95th percentile of latency_us by run, strategy and type.

    The states of a run's days, each made by itself, are merged and give the first digit; the digits below are followed
    in the measurements of the buckets that hold a target.
    """
    changes = materialise(_salted(latency_changes(spark, sf_dir)))
    g = MEASUREMENT[:3]
    days = day_states(changes, g, "run_day", STATE_BITS)
    state = materialise(merge_states(days.drop("run_day")))
    rows = changes.filter("last").select(*g, F.col("key").alias("_k"), "_s")
    out = select_ranks(rows, g, ["0.5", "0.95"], 20, T.DoubleType(), state, STATE_BITS)
    return out.select(*g, "n", F.col("p50").cast("bigint").alias("p50"), F.col("p95").cast("bigint").alias("p95"))


def p1_found(spark, sf_dir: str) -> DataFrame:
    """Groups whose 95th percentile is at least ten times their median."""
    return p1_percentiles(spark, sf_dir).filter("p95 >= 10 * p50").select("run_id", "strategy", "type")


def p1_days(spark, sf_dir: str) -> DataFrame:
    """Bounds of median and 95th percentile by strategy and type over all runs, from one mergeable state per day alone."""
    days = day_states(latency_changes(spark, sf_dir), MEASUREMENT[:3], "run_day", STATE_BITS)
    out = state_percentiles(merge_states(days.drop("run_id", "run_day")), ["strategy", "type"], ["0.5", "0.95"], STATE_BITS)
    return out.select("strategy", "type", "n", "q", F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))
