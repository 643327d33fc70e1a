"""First-come representatives: which upload is stored and which reuses an earlier one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hamloom.functions.bits import hamming, with_words, words_of
from hamloom.functions.text import threshold_for
from hamloom.operators.search import _parts
from hamloom.session import materialise

#: Differing bits that the recovery code corrects; its last bit is stored apart and doesn't count.
CORRECTED = 6


def _reusable(a: DataFrame, b: DataFrame, spec: str, further: Column) -> DataFrame:
    """(a, b, distance): pairs of rows of a and b (cls, type, tag, recovery, ...) that fit each other (see reusable_links)."""
    rows = lambda df: _parts(with_words(with_words(df), "recovery", "r_"), spec)
    # bit 255, counted from the least significant of each byte, is the top bit of the last byte
    top = F.lit(~(1 << 7)).cast("bigint")
    a, b = rows(a).alias("a"), rows(b).alias("b")
    same = (F.col("a.type") == F.col("b.type")) & (F.col("a.segment") == F.col("b.segment")) & (F.col("a.value") == F.col("b.value")) & further
    ra, rb = words_of("r_", "a"), words_of("r_", "b")
    noise = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(ra[:3], rb[:3], strict=True)), F.bit_count(ra[3].bitwiseXOR(rb[3]).bitwiseAND(top)))
    near = hamming(words_of(alias="a"), words_of(alias="b"))
    return a.join(b, same & (near <= F.col("a.delta")) & (noise <= CORRECTED)).select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b"), near.alias("distance")).distinct()


def reusable_links(uploads: DataFrame, spec: str = "default=6") -> DataFrame:
    """(a, b, distance): classes of uploads (cls, type, tag, recovery) of which b can reuse a and a can reuse b.

    Tags of one type are within the type's distance, and recovery representations differ in at most CORRECTED of their
    bits 0 to 254 (the last bit of the last byte is not compared).
    """
    rows = uploads.select("cls", "type", "tag", "recovery")
    return _reusable(rows, rows, spec, F.col("a.cls") != F.col("b.cls"))


def reusable_stored(uploads: DataFrame, stored: DataFrame, spec: str = "default=6") -> DataFrame:
    """(a, b, distance): classes a of uploads that can reuse the representative b of stored, which isn't compared with itself."""
    cols = ["cls", "type", "tag", "recovery"]
    return _reusable(uploads.select(*cols), stored.select(*cols), spec, F.lit(True))


def greedy(nodes: DataFrame, links: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(cls, pos, stored) for nodes (cls, pos) in order of pos: stored unless an earlier stored node is linked.

    Nodes of held (cls) aren't stored in any case. Each round stores every open node without an earlier open or stored
    neighbour and settles those with a stored one; settled nodes leave the table of open links, and rounds go on until it is
    empty: the first open node is settled in every round. links is symmetric. What a round settles is written to the shared folder.
    """
    at = links.join(nodes.select(F.col("cls").alias("a"), F.col("pos").alias("pa")), "a").join(nodes.select(F.col("cls").alias("b"), F.col("pos").alias("pb")), "b")
    if held is not None:
        # a held node neither waits nor is waited for
        for c in ("a", "b"):
            at = at.join(held.select(F.col("cls").alias(c)), c, "left_anti")
    open_ = materialise(at.filter("pb < pa").select("a", "b", F.lit(False).alias("hit")))
    lone = nodes.join(open_.select(F.col("a").alias("cls")).distinct(), "cls", "left_anti")
    if held is not None:
        lone = lone.join(held.select("cls"), "cls", "left_anti")
    now = materialise(lone.select("cls", F.lit(True).alias("stored")))
    done, rounds = now, 0
    while not open_.isEmpty():
        # links to what has just been settled are answered: a stored one is a hit, one that isn't no longer counts
        seen = open_.join(now.select(F.col("cls").alias("b"), "stored"), "b", "left")
        left = materialise(seen.filter("stored is null or stored").select("a", "b", (F.col("hit") | F.coalesce("stored", F.lit(False))).alias("hit")))
        waits = left.groupBy("a").agg(F.max("hit").alias("any"), F.count_if(~F.col("hit")).alias("waiting"))
        gone = open_.select("a").distinct().join(waits, "a", "left")
        now = materialise(gone.filter("any or waiting = 0 or any is null").select(F.col("a").alias("cls"), (~F.coalesce("any", F.lit(False))).alias("stored")))
        open_ = materialise(left.join(now.select(F.col("cls").alias("a")), "a", "left_anti"))
        done, rounds = done.unionByName(now), rounds + 1
        if rounds % 20 == 0:
            done = materialise(done)
    out = nodes.join(done, "cls")
    return out if held is None else out.unionByName(nodes.join(held.select("cls"), "cls", "left_semi").withColumn("stored", F.lit(False)))


def assign(uploads: DataFrame, spec: str = "default=6", stored: DataFrame | None = None) -> DataFrame:
    """(id, rid, distance, stored) for uploads (id, pos, type, tag, recovery) in order of pos.

    An upload reuses the nearest stored earlier one (by distance, then position) that it can reuse, else it is stored; rid is
    the stored one's id. Of uploads equal in type, tag and recovery only the first can be stored, so only firsts are
    compared; each of the others reuses the nearest of what is stored before itself. ids and pos are unique. Types without a
    threshold use the default; null tags or types have no row.

    stored has the representatives (id, pos, type, tag, recovery) of before, which come before all uploads (in order of
    their own pos). Uploads are compared with them and with one another, they themselves with nothing.
    """
    rows = uploads.filter("tag is not null and type is not null and recovery is not null")
    first = rows.groupBy("type", "tag", "recovery").agg(F.min(F.struct("pos", "id")).alias("f"))
    cls = materialise(first.select(F.col("f.pos").alias("cls"), F.col("f.pos").alias("pos"), F.col("f.id").alias("id"), "type", "tag", "recovery", threshold_for("type", spec).alias("limit")))
    links = materialise(reusable_links(cls, spec))
    held, before = None, None
    if stored is not None:
        # of equal representatives the first counts
        old = stored.groupBy("type", "tag", "recovery").agg(F.min(F.struct("pos", "id")).alias("f")).select(F.col("f.pos").alias("cls"), F.col("f.id").alias("id"), "type", "tag", "recovery")
        known = reusable_stored(cls, old, spec).join(old.select(F.col("cls").alias("b"), F.col("id").alias("rid")), "b")
        # a representative comes before all uploads: first 0, then its place
        before = materialise(known.select(F.col("a").alias("cls"), "distance", F.lit(0).alias("late"), F.col("b").alias("at"), "rid"))
        held = before.select("cls").distinct()
    state = greedy(cls.select("cls", "pos"), links, held)
    # what an upload of a class can reuse: stored classes that are linked to it, and the class itself if it is stored
    kept = cls.join(state.filter("stored").select("cls"), "cls").select(F.col("cls").alias("b"), F.col("pos").alias("at"), F.col("id").alias("rid"))
    option = lambda df: df.select("cls", "distance", F.lit(1).alias("late"), "at", "rid")
    options = option(links.withColumnRenamed("a", "cls").join(kept, "b")).unionByName(option(kept.withColumnRenamed("b", "cls").withColumn("distance", F.lit(0))))
    if before is not None:
        options = options.unionByName(before)
    at = rows.join(cls.select("type", "tag", "recovery", "cls"), ["type", "tag", "recovery"]).select("id", "pos", "cls")
    met = at.join(options, "cls").filter("late = 0 or at < pos").groupBy("id").agg(F.min(F.struct("distance", "late", "at", "rid")).alias("m"))
    out = at.join(met, "id", "left")
    return out.select("id", F.coalesce("m.rid", "id").alias("rid"), F.coalesce("m.distance", F.lit(0)).cast("int").alias("distance"), F.col("m").isNull().alias("stored"))
