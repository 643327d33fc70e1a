"""The two-level membership filter as a relation of fingerprints."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

# Fingerprints per bin, fill of a bin, bytes of a bin and of a spare entry; the constants of FNV-1a and of the mixing steps.
BIN_CAPACITY, BIN_FILL, BIN_BYTES, SPARE_BYTES = 25, 0.95, 104, 16
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
MIX_1, MIX_2, GOLDEN = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def sizing(capacity: int, fpp: float) -> tuple[int, int]:
    """(fingerprint bits, bins) for a capacity and a false positive rate."""
    if capacity <= 0 or not 0 < fpp < 1:
        raise ValueError("capacity must be positive and the rate between 0 and 1")
    bits = max(8, math.ceil(math.log2(4 * BIN_CAPACITY / fpp)))
    if bits > 32:
        raise ValueError("the rate needs fingerprints of more than 32 bits")
    return bits, max(1, math.ceil(capacity / (BIN_CAPACITY * BIN_FILL)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def fingerprints(values: list[bytes], bins: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, mini) of byte values: all of one length are hashed together, position by position."""
    bin_, mini = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    lengths = np.array([len(v) for v in values])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        data = np.frombuffer(b"".join(values[i] for i in at), np.uint8).reshape(len(at), n)
        h = np.full(len(at), FNV_OFFSET, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n):
                h = (h ^ data[:, j]) * np.uint64(FNV_PRIME)
            bin_[at] = (_mix(h) % bins[at].astype(np.uint64)).astype(np.int64)
            mini[at] = (_mix(h ^ np.uint64(GOLDEN)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    return bin_, mini


def fingerprint(value: Column, bins: Column, bits: int) -> Column:
    """struct(bin, mini) of a binary value."""

    @F.pandas_udf(T.StructType([T.StructField("bin", T.LongType()), T.StructField("mini", T.LongType())]))
    def run(values: pd.Series, n: pd.Series) -> pd.DataFrame:
        b, m = fingerprints([bytes(v) for v in values], n.to_numpy(np.int64), bits)
        return pd.DataFrame({"bin": b, "mini": m})

    return run(value, bins)


def filter_entries(values: DataFrame, capacity: DataFrame, fpp: float) -> DataFrame:
    """(type, segment, bin, mini, spare) of the distinct values (type, segment, value binary) of every filter.

    capacity has (type, n), the records a type's filters are made for. A bin keeps its 25 smallest fingerprints and an exact
    spare the rest, so a value may be contained exactly if its (bin, mini) is an entry: which filter holds it is only needed for
    its size. `spare` marks entries beyond the 25th of their bin.
    """
    rows = with_fingerprint(values.distinct(), capacity, fpp)
    entries = rows.select("type", "segment", "bin", "mini").distinct()
    return entries.withColumn("spare", F.row_number().over(W.partitionBy("type", "segment", "bin").orderBy("mini")) > BIN_CAPACITY)


def with_fingerprint(values: DataFrame, capacity: DataFrame, fpp: float) -> DataFrame:
    """values (type, segment, value, ...) with the bin and fingerprint in their type's filter; types without records drop out."""
    bits, _ = sizing(1, fpp)
    bins = F.greatest(F.ceil(F.col("n") / F.lit(BIN_CAPACITY * BIN_FILL)), F.lit(1)).cast("bigint")
    sized = capacity.select("type", bins.alias("bins"))
    joined = values.join(F.broadcast(sized), "type")  # one row per type
    return joined.withColumn("fp", fingerprint(F.col("value"), F.col("bins"), bits)).select(*values.columns, "fp.bin", "fp.mini")


def filter_bytes(entries: DataFrame, capacity: DataFrame, segments: int) -> DataFrame:
    """(type, bytes) of a type's filters: all bins of every segment, and the spare entries."""
    bins = F.greatest(F.ceil(F.col("n") / F.lit(BIN_CAPACITY * BIN_FILL)), F.lit(1)).cast("bigint")
    spare = entries.filter("spare").groupBy("type").agg(F.count(F.lit(1)).alias("spares"))
    return capacity.join(spare, "type", "left").select("type", (bins * F.lit(BIN_BYTES * segments) + F.coalesce("spares", F.lit(0)) * F.lit(SPARE_BYTES)).cast("bigint").alias("bytes"))


def bloom_positions(value: Column, hashes: int, bits: int) -> Column:
    """The bits of a Bloom filter that a binary value sets: for i from 0, the first 64 bits of SHA-256 over the value and i (four
    big-endian bytes), modulo `bits`."""
    def place(i: Column) -> Column:
        digest = F.sha2(F.concat(value, F.unhex(F.lpad(F.hex(i.cast("bigint")), 8, "0"))), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(bits).cast("decimal(20,0)")).cast("bigint")

    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), place)
