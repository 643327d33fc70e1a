"""Tags of videos from the tags of their frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hamloom.operators.skew import with_positions


def video_tags(frames: DataFrame, most: int = 32) -> DataFrame:
    """(video, tag) of frames (video, frame, tag of 64 hex digits): per bit the majority over at most `most` evenly spaced frames.

    Ties set a bit. Null tags and videos are left out; a video without frames gives no row. Frames are numbered by range
    partitions, so a video may have any number of them; only the chosen ones are voted on.
    """
    rows = with_positions(frames.filter("tag is not null and video is not null").select("video", "frame", "tag"), ["video", "frame"], "place")
    size = rows.groupBy("video").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    at, take = F.col("place") - F.col("start"), F.least(F.col("n"), F.lit(most))
    # of `take` chosen frames, number i is the one at floor(i n / take)
    i = F.floor((at * take + F.col("n") - 1) / F.col("n"))
    chosen = rows.join(size, "video").filter((i < take) & (F.floor(i * F.col("n") / take) == at))
    digits = chosen.select("video", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.conv(F.substring("tag", 2 * b + 1, F.lit(2)), 16, 10).cast("int"))).alias("byte", "v"))
    votes = digits.groupBy("video", "byte").agg(F.count(F.lit(1)).alias("c"), *[F.sum(F.shiftright("v", k).bitwiseAND(F.lit(1))).alias(f"s{k}") for k in range(8)])
    value = sum((F.when(2 * F.col(f"s{k}") >= F.col("c"), 1 << k).otherwise(0) for k in range(8)), F.lit(0))
    both = votes.select("video", F.struct("byte", F.lower(F.lpad(F.hex(value.cast("bigint")), 2, "0")).alias("hex")).alias("b"))
    return both.groupBy("video").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["hex"]), "").alias("tag"))  # 32 bytes a video
