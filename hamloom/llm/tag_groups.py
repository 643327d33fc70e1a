"""Groups of tags that differ in a few bits, by an inverted index over byte positions with count filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hamloom.functions.bits import WORDS, differing_bytes, hamming, with_words, words_of
from hamloom.operators.store import distinct_tags, record_tags
from hamloom.operators.components import connected_components
from hamloom.operators.skew import lookup_unique
from hamloom.session import materialise

#: A posting list longer than this is replaced by lists over a further run of byte positions.
LIST_LIMIT = 1000
DEPTH = 3


def byte_runs(positions: list[tuple[int, int]], parts: int) -> list[list[tuple[int, int]]]:
    """Cut byte ranges into `parts` runs of nearly equal size; a run is a list of (first, end) byte positions."""
    flat = [p for a, b in positions for p in range(a, b)]
    out = []
    for j in range(parts):
        run = flat[len(flat) * j // parts : len(flat) * (j + 1) // parts]
        ranges: list[tuple[int, int]] = []
        for p in run:
            if ranges and ranges[-1][1] == p:
                ranges[-1] = (ranges[-1][0], p + 1)
            else:
                ranges.append((p, p + 1))
        out.append(ranges)
    return out


def _take(ranges: list[tuple[int, int]]):
    return F.concat(*[F.substring("tag", 2 * a + 1, 2 * (b - a)) for a, b in ranges])


def near_links(tags: DataFrame, radius: int, size: int = 32, list_limit: int = LIST_LIMIT) -> DataFrame:
    """(a, b): the ids of all pairs of tags of one type at most `radius` bits apart, each once, a < b.

    tags has (id bigint, type, tag), tag being `size` bytes of lower-case hex, each tag of a type once.

    Two such tags share all but `radius` of their bytes. The inverted index has, per type, a list for the bytes at
    every one of radius + 1 runs of positions: at least one run is untouched by the differing bits, so every pair
    meets in some list. (Lists over single positions would hold 1/256 of all tags each; runs of 4 or 5 positions
    keep them short.) Where pairs meet, the positional bytes they share are tallied from the xor of their words, pairs
    below size - radius are dropped, and the distance of the rest is verified, all inside the join's condition, so
    no other pair is ever written. A list longer than list_limit is replaced by lists over radius + 1 runs of its
    tags' other positions (which the same argument covers), up to DEPTH times; this loses nothing.
    """
    parts = radius + 1
    rows = with_words(tags.select("id", "type", "tag"))
    pending = rows.withColumn("path", F.lit(""))
    depth = DEPTH if size >= 32 else 1
    all_lists: list[DataFrame] = []

    def keyed(df: DataFrame, free: list[tuple[int, int]], name: str) -> DataFrame:
        runs = byte_runs(free, parts)
        key = F.array(*[F.struct(F.lit(j).alias("run"), F.concat(F.lit(f"{name}{j}:"), _take(r)).alias("key")) for j, r in enumerate(runs)])
        return df.withColumn("k", F.explode(key)).select("id", "type", "tag", *WORDS, "path", F.col("k.run").alias("run"), F.concat("path", F.lit("/"), F.col("k.key")).alias("key"))

    def lists(df: DataFrame, free: list[tuple[int, int]], name: str, left: int) -> None:
        runs = byte_runs(free, parts)
        at = keyed(df, free, name)
        short = min((sum(b - a for a, b in r) for r in runs), default=0)
        if left == 0 or short < 2:
            all_lists.append(at)
            return
        long = materialise(at.groupBy("type", "key", "run").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > list_limit).select("type", "key", "run"))
        found = {r["run"] for r in long.select("run").distinct().collect()}  # at most radius + 1 numbers
        if not found:
            all_lists.append(at)
            return
        all_lists.append(at.join(long, ["type", "key", "run"], "left_anti"))
        hot = materialise(at.join(long, ["type", "key", "run"], "left_semi"))
        for j in sorted(found):
            used = {p for a, b in runs[j] for p in range(a, b)}
            rest = [p for a, b in free for p in range(a, b) if p not in used]
            ranges = byte_runs([(p, p + 1) for p in rest], 1)[0]
            lists(hot.filter(F.col("run") == j).select("id", "type", "tag", *WORDS, F.col("key").alias("path")), ranges, f"{name}{j}.", left - 1)

    lists(pending, [(0, size)], "", depth)
    both = all_lists[0].select("id", "type", "key", *WORDS)
    for x in all_lists[1:]:
        both = both.unionByName(x.select("id", "type", "key", *WORDS))
    a, b = both.alias("a"), both.alias("b")
    wa, wb = words_of(alias="a"), words_of(alias="b")
    tally = F.lit(size) - differing_bytes(wa, wb)
    meet = (F.col("a.type") == F.col("b.type")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id"))
    pairs = a.join(b, meet & (tally >= size - radius) & (hamming(wa, wb) <= radius))
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def tag_groups(tags: DataFrame, radius: int = 6) -> DataFrame:
    """(id, group_id) of every tag that has another tag of its type within radius, links chaining."""
    links = near_links(tags, radius)
    return connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("group_id"))


def _grouped(spark, sf_dir: str, radius: int) -> tuple[DataFrame, DataFrame]:
    """All distinct tags, and those of them in a group of at least two with their group_id."""
    tags = materialise(distinct_tags(spark, sf_dir))
    groups = tag_groups(tags.select(F.col("record_id").alias("id"), "type", "tag"), radius)
    return tags, materialise(tags.join(groups.withColumnRenamed("id", "record_id"), "record_id"))


def p6_groups(spark, sf_dir: str, radius: int = 6) -> DataFrame:
    """(type, tag, record_id, n, group_id): one row per distinct tag in a group of at least two."""
    return _grouped(spark, sf_dir, radius)[1]


def p6_found(spark, sf_dir: str, radius: int = 6) -> DataFrame:
    """(group_id, record_id): every record of a group with at least two different tags.

    A tag that very many records share is compared once; its records join the group's row by lookup_unique.
    """
    tags, classes = _grouped(spark, sf_dir, radius)
    rows = record_tags(spark, sf_dir).filter("tag is not null and type is not null")
    out = lookup_unique(rows, classes.select("type", "tag", "group_id"), ["type", "tag"], tags.select("type", "tag", "n"))
    return out.filter("group_id is not null").select("group_id", "record_id")
