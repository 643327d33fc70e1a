"""Radius search, global minimum and weight-band first match over 256-bit tags.

Records and queries are first brought down to their distinct tags: a tag that very many records share is compared once, its
number of records is carried along, and counters are multiplied. Results are pairs of distinct tags.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hamloom.functions.bits import WORDS, hamming, segment_bounds, segment_blobs, segment_keys, weight, with_words, words_of
from hamloom.functions.text import parse_thresholds, threshold_for
from hamloom.operators.filters import filter_entries, with_fingerprint
from hamloom.operators.skew import with_positions
from hamloom.operators.text_sets import read_columns
from hamloom.session import materialise, shared_dir, widen

#: Distinct query tags that are broadcast at once to the scan (48 bytes each).
SCAN_BLOCK = 50_000
#: Queries (id, type, number) that are broadcast at once to ranked candidates, and ranked rows that a task gives at once.
SENT_QUERIES, RANKED = 500_000, 50_000


def distinct_of(rows: DataFrame) -> DataFrame:
    """(type, tag, n) of rows (type, tag); null tags and types are left out."""
    return rows.filter("tag is not null and type is not null").groupBy("type", "tag").agg(F.count(F.lit(1)).alias("n"))


def _parts(df: DataFrame, spec: str) -> DataFrame:
    """One row per segment of every tag; a type's tags have as many segments as its distance plus one."""
    limits = parse_thresholds(spec)
    counts = sorted(set(limits.values()))
    delta = threshold_for("type", spec)
    keys = None
    for d in counts:
        k = segment_keys("tag", 256, d + 1)
        keys = F.when(delta == d, k) if keys is None else keys.when(delta == d, k)
    return df.withColumn("delta", delta).withColumn("s", F.explode(keys)).select(*df.columns, "delta", F.col("s.segment").alias("segment"), F.col("s.value").alias("value"))


def blocks_of(queries: DataFrame, block: int, key: str = "tag") -> list[DataFrame]:
    """The rows in hash blocks of about `block` rows at most; their number is checked by a count."""
    n = max(1, -(-queries.count() // block))
    return [queries] if n == 1 else [queries.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def radius_scan(records: DataFrame, queries: DataFrame, spec: str = "default=6", block: int = SCAN_BLOCK) -> DataFrame:
    """(type, query_tag, tag, distance, n) by comparing every distinct query tag with every record tag of its type.

    The stated queries are broadcast in blocks of checked size past the records, which are not shuffled.
    """
    r = widen(materialise(with_words(distinct_of(records)))).alias("r")
    q = with_words(distinct_of(queries).drop("n"), prefix="q_")
    q = q.withColumn("delta", threshold_for("type", spec)).withColumnRenamed("tag", "query_tag")
    d = hamming(words_of(alias="r"), words_of("q_", "q"))
    out = []
    for part in blocks_of(q.withColumnRenamed("query_tag", "tag"), block):
        p = F.broadcast(part.withColumnRenamed("tag", "query_tag")).alias("q")
        out.append(r.join(p, (F.col("r.type") == F.col("q.type")) & (d <= F.col("q.delta"))).select("r.type", "q.query_tag", "r.tag", d.alias("distance"), "r.n"))
    return reduce(DataFrame.unionByName, out)


def radius_exact(records: DataFrame, queries: DataFrame, spec: str = "default=6") -> DataFrame:
    """The rows of radius_scan by the inverted index: two tags within distance d agree on one of d + 1 segments.

    Segments are joined on (type, segment, value); a pair is verified in the join's condition and kept once. Tags go by their words,
    which are half as long, and are spelled again in the pairs that are left.
    """
    r = _parts(with_words(distinct_of(records)), spec).drop("tag", "delta").alias("r")
    q = _parts(with_words(distinct_of(queries).drop("n"), prefix="q_"), spec).drop("tag").alias("q")
    d = hamming(words_of(alias="r"), words_of("q_", "q"))
    same = (F.col("r.type") == F.col("q.type")) & (F.col("r.segment") == F.col("q.segment")) & (F.col("r.value") == F.col("q.value"))
    spelled = lambda ws: F.concat(*[F.lower(F.lpad(F.hex(w), 16, "0")) for w in ws])
    return r.join(q, same & (d <= F.col("q.delta"))).select("r.type", spelled(words_of("q_", "q")).alias("query_tag"), spelled(words_of(alias="r")).alias("tag"), d.alias("distance"), "r.n").distinct()


def posting_rows(records: DataFrame, spec: str) -> DataFrame:
    """(type, segment, value binary, record_id) of records (record_id, type, tag), each type at its own distance."""
    limits = parse_thresholds(spec)
    delta = threshold_for("type", spec)
    blobs = None
    for d in sorted(set(limits.values())):
        k = segment_blobs("tag", 256, d + 1)
        blobs = F.when(delta == d, k) if blobs is None else blobs.when(delta == d, k)
    rows = records.filter("tag is not null and type is not null").withColumn("s", F.explode(blobs))
    return rows.select("type", F.col("s.segment").alias("segment"), F.col("s.value").alias("value"), "record_id")


def postings(records: DataFrame, delta: int = 6) -> DataFrame:
    """The rows of posting_rows at one distance for all types."""
    return posting_rows(records, f"default={delta}")


def candidates(records: DataFrame, queries: DataFrame, spec: str = "default=6", block: int = SENT_QUERIES) -> DataFrame:
    """(query_id, type, record_id, distance, rank): every record within the distance of every query (query_id, type, tag).

    Ranks go by (distance, record_id), the order in which candidates are tried, and are the same for all queries of a tag. Distinct
    tags are matched once (radius_exact); a query tag's records are ranges of the matched records in order of their tags, which a
    task reads (8 bytes each), merges and ranks. Ranked rows meet the queries of their tag in the same task, which are broadcast in
    blocks of counted size. So of the rows that come out, as many as there are candidates, none is shuffled or sorted.
    """
    spark = records.sparkSession
    hits = materialise(radius_exact(records, queries, spec).select("type", "query_tag", "tag", "distance"))
    mine = records.select("type", "tag", "record_id").join(hits.select("type", "tag").distinct(), ["type", "tag"], "left_semi")
    path = shared_dir(spark)
    placed = materialise(with_positions(mine, ["type", "tag", "record_id"], "place").select("type", "tag", "record_id", "place"), path)
    ranges = placed.groupBy("type", "tag").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    lists = hits.join(ranges, ["type", "tag"]).groupBy("type", "query_tag").agg(F.collect_list(F.struct("distance", "start", "n")).alias("lists"))
    lists = materialise(lists.withColumn("k", F.monotonically_increasing_id()))
    # query tags differ much in their work, so they are dealt out finely
    dealt = lists.select("k", "lists").repartition(8 * spark.sparkContext.defaultParallelism)
    ranked = dealt.mapInArrow(_ranked(path), "k bigint, record_id bigint, distance int, rank int")
    q = queries.filter("tag is not null and type is not null").select("query_id", "type", F.col("tag").alias("query_tag"))
    q = materialise(q.join(lists.select("type", "query_tag", "k"), ["type", "query_tag"]).select("query_id", "type", "k"))
    cols = ("query_id", "type", "record_id", "distance", "rank")
    out = [ranked.join(F.broadcast(part), "k").select(*cols) for part in blocks_of(q, block, "query_id")]
    return reduce(DataFrame.unionByName, out)


def _ranked(path: str) -> Callable:
    """Turns lists of (distance, start, n) by k, ranges of the records' places in the table at `path`, into ranked records."""

    def batches_of(k: int, lists: list[dict], known: np.ndarray) -> Iterator[pa.RecordBatch]:
        distance = np.repeat(np.array([x["distance"] for x in lists], np.int32), [x["n"] for x in lists])
        ids = np.concatenate([known[x["start"] : x["start"] + x["n"]] for x in lists])
        order = np.lexsort((ids, distance)) if len(lists) > 1 else np.arange(len(ids))
        ids, distance, rank = ids[order], distance[order], np.arange(1, len(ids) + 1, dtype=np.int32)
        for s in range(0, len(ids), RANKED):
            e = s + RANKED
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids[s:e]), k)), pa.array(ids[s:e]), pa.array(distance[s:e]), pa.array(rank[s:e])], names=["k", "record_id", "distance", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = None, [], 0
        for b in batches:
            if known is None:
                t = read_columns(path, ["record_id", "place"])
                known = np.empty(t.num_rows, np.int64)
                known[t["place"].to_numpy()] = t["record_id"].to_numpy()
                del t
            for k, lists in zip(b["k"].to_pylist(), b["lists"].to_pylist(), strict=True):
                for one in batches_of(k, lists, known):
                    held.append(one)
                    size += one.num_rows
                    if size >= RANKED:
                        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return run


def radius_prefuzz(records: DataFrame, queries: DataFrame, delta: int = 6, fpp: float = 0.01) -> DataFrame:
    """The rows of radius_exact, looking up only those segments of the queries that the membership filter passes."""
    r, q = distinct_of(records), distinct_of(queries).drop("n")
    capacity = r.groupBy("type").agg(F.sum("n").alias("n"))
    stored = r.withColumn("s", F.explode(segment_blobs("tag", 256, delta + 1))).select("type", "s.segment", "s.value")
    asked = q.withColumn("s", F.explode(segment_blobs("tag", 256, delta + 1))).select("type", "tag", "s.segment", "s.value")
    entries = filter_entries(stored.distinct(), capacity, fpp).drop("spare")
    passed = with_fingerprint(asked, capacity, fpp).join(entries, ["type", "segment", "bin", "mini"], "left_semi").select("type", "tag", "segment")
    spec = f"default={delta}"
    rs = _parts(with_words(r), spec).alias("r")
    qs = _parts(with_words(q, prefix="q_"), spec).join(passed, ["type", "tag", "segment"], "left_semi").alias("q")
    d = hamming(words_of(alias="r"), words_of("q_", "q"))
    same = (F.col("r.type") == F.col("q.type")) & (F.col("r.segment") == F.col("q.segment")) & (F.col("r.value") == F.col("q.value"))
    return rs.join(qs, same & (d <= delta)).select("r.type", F.col("q.tag").alias("query_tag"), "r.tag", d.alias("distance"), "r.n").distinct()


def radius_counters(records: DataFrame, queries: DataFrame, delta: int = 6, fpp: float = 0.01) -> DataFrame:
    """One row per strategy and query (query_id, type, tag) with the work it takes.

    scan computes the distance to every record of the type; exact looks every segment up, reads the postings there and
    computes the distance once per record; prefuzz looks up only the segments that the membership filter passes.
    Queries with an unreadable tag have no row.
    """
    r, q = materialise(distinct_of(records)), materialise(distinct_of(queries).drop("n"))
    totals = r.groupBy("type").agg(F.sum("n").alias("records"))
    parts_of = lambda df, *more: df.withColumn("s", F.explode(segment_blobs("tag", 256, delta + 1))).select("type", "tag", *more, F.col("s.segment").alias("segment"), F.col("s.value").alias("value"))
    # a record's postings count wherever a query asks for their value; of equal values a list is made once
    keys = ["type", "segment", "value"]
    lists = parts_of(r, "n").groupBy(*keys).agg(F.sum("n").alias("postings"))
    qs = parts_of(q)
    met = materialise(parts_of(r, "n").withColumnRenamed("tag", "other").join(qs, keys).select("type", "tag", "other", "n", "segment", "value"))
    # the lists of the values that are asked for, with which of them are really stored
    read = met.groupBy("type", "tag", "segment").agg(F.sum("n").alias("postings")).groupBy("type", "tag").agg(F.sum("postings").alias("read"))
    pairs = with_words(with_words(met.select("type", "tag", "other", "n").distinct()), "other", "o_")
    full = pairs.groupBy("type", "tag").agg(F.sum("n").alias("full"), F.sum(F.when(hamming(words_of(), words_of("o_")) <= delta, F.col("n")).otherwise(0)).alias("found"))
    capacity = totals.select("type", F.col("records").alias("n"))
    entries = filter_entries(lists.select(*keys), capacity, fpp)
    # fingerprints of the distinct values that are asked for
    values = with_fingerprint(qs.select(*keys).distinct(), capacity, fpp).join(entries.drop("spare"), ["type", "segment", "bin", "mini"], "left_semi").select(*keys)
    passed = qs.join(values, keys, "left_semi").groupBy("type", "tag").agg(F.count(F.lit(1)).alias("passed"))
    one = q.join(read, ["type", "tag"], "left").join(full, ["type", "tag"], "left").join(passed, ["type", "tag"], "left").join(F.broadcast(totals), "type", "left").fillna(0)
    known = F.col("records") > 0

    def row(name: str, *cols: Column) -> Column:
        names = ("filter_queries", "inverted_lookups", "posting_records_read", "full_tag_distance_computations")
        return F.struct(F.lit(name).alias("strategy"), *[c.cast("bigint").alias(n) for c, n in zip(cols, names, strict=True)])

    zero, parts = F.lit(0), F.when(known, F.lit(delta + 1)).otherwise(0)
    each = F.array(row("scan", zero, zero, zero, F.col("records")), row("exact", zero, parts, F.col("read"), F.col("full")), row("prefuzz", parts, F.col("passed"), F.col("read"), F.col("full")))
    rows = one.select("type", "tag", F.col("found").cast("bigint").alias("candidate_count"), F.explode(each).alias("s"))
    return queries.filter("tag is not null and type is not null").select("query_id", "type", "tag").join(rows, ["type", "tag"]).select("s.strategy", "query_id", "type", "candidate_count", "s.filter_queries", "s.inverted_lookups", "s.posting_records_read", "s.full_tag_distance_computations")


def global_min(records: DataFrame, queries: DataFrame, threshold: int = 6, block: int = SCAN_BLOCK) -> DataFrame:
    """(query_id, best_distance, matched, records_examined, bits_compared): the smallest distance to any record of any type.

    Every query counts as examining all records, 256 bits each; without records the distance is 257. Queries with a
    record within NEAR bits are settled by the inverted index; only the others go past all distinct tags, in broadcast blocks of
    checked size, each task keeping the minimum per query tag (nearest_in).
    """
    r = materialise(with_words(records.filter("tag is not null").select("tag").distinct()))
    total = records.filter("tag is not null").select(F.count(F.lit(1))).scalar()
    tags = materialise(queries.filter("tag is not null").select("tag").distinct())
    one = F.lit("").alias("type")
    near = radius_exact(r.select(one, "tag"), tags.select(one, "tag"), f"default={NEAR}")
    near = materialise(near.groupBy(F.col("query_tag").alias("tag")).agg(F.min("distance").alias("d")))
    rest = materialise(tags.join(near, "tag", "left_anti"))
    best = [near.select("tag", F.col("d").cast("int").alias("d"))]
    wide = widen(r)
    for part in blocks_of(rest, block):
        # a scan by definition: every record is compared with every query of the block
        best.append(nearest_in(wide, part).groupBy("tag").agg(F.min("d").alias("d")))
    found = reduce(DataFrame.unionByName, best)
    out = queries.filter("tag is not null").select("query_id", "tag").join(found, "tag", "left")
    d = F.coalesce("d", F.lit(257)).cast("int")
    return out.select("query_id", d.alias("best_distance"), (d <= threshold).cast("int").alias("matched"), total.cast("bigint").alias("records_examined"), (total * 256).cast("bigint").alias("bits_compared"))


#: Distance up to which global_min asks the inverted index first.
NEAR = 6


def nearest_in(records: DataFrame, queries: DataFrame) -> DataFrame:
    """(tag, d int) by every task of records (WORDS): the smallest distance of each query (tag) to the task's records.

    queries are a block of counted size that is sent to all tasks, of tags with a distance of at least 1 to all records. A query
    passes a batch of records in a few vector operations, and no row is made for a pair.
    """
    asked = with_words(queries.select("tag")).toArrow()
    sent = records.sparkSession.sparkContext.broadcast((asked["tag"].to_pylist(), np.stack([asked[w].to_numpy() for w in WORDS], 1).view(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags, asked = sent.value
        best, met = np.full(len(tags), 255, np.uint8), False
        for b in batches:
            if not b.num_rows or not tags:
                continue
            met = True
            own = [b[w].to_numpy().view(np.uint64) for w in WORDS]
            bits, one, sums = np.empty(b.num_rows, np.uint64), np.empty(b.num_rows, np.uint8), np.empty(b.num_rows, np.uint8)
            for k, words in enumerate(asked):
                np.bitwise_count(np.bitwise_xor(own[0], words[0], out=bits), out=sums)
                for i in (1, 2, 3):
                    np.add(sums, np.bitwise_count(np.bitwise_xor(own[i], words[i], out=bits), out=one), out=sums)
                # 1 to 256 as 0 to 255, which a byte holds
                best[k] = min(best[k], np.subtract(sums, 1, out=sums).min())
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(tags, pa.string()), pa.array(best.astype(np.int32) + 1)], names=["tag", "d"])

    return records.select(*WORDS).mapInArrow(run, "tag string, d int")


def first_match(records: DataFrame, queries: DataFrame, threshold: int = 6) -> DataFrame:
    """(query_id, best_distance, matched, records_examined, bits_compared): the first record within the threshold among those
    whose weight differs by no more, in order of (weight, record_id).

    Unmatched queries examine the whole band and have the distance threshold + 1, or 257 when the band is empty. A record
    costs 64 bits if its first word alone exceeds the threshold, 128 if the first two do, else 256.

    How many records are examined follows from places: records are numbered in that order, the band's first place is a sum
    over at most 257 weights, the hit's its number. All of them cost 64 bits; more only those near in the first word, which
    an equi-join on its threshold + 1 segments finds (distinct first words are compared once). So no query meets its band.
    """
    t = threshold
    rows = with_words(records.filter("tag is not null").select("record_id", "tag"))
    placed = materialise(with_positions(rows.withColumn("weight", weight(words_of())), ["weight", "record_id"], "place"))
    per = placed.groupBy("weight").agg(F.count(F.lit(1)).alias("n"))  # at most 257 rows
    tags = materialise(placed.groupBy("tag", *WORDS, "weight").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n")))
    q = with_words(queries.filter("tag is not null").select("tag").distinct(), prefix="q_").withColumnRenamed("tag", "query_tag").withColumn("q_weight", weight(words_of("q_")))
    q = materialise(q)
    band = F.sequence(F.greatest(F.col("q_weight") - t, F.lit(0)), F.least(F.col("q_weight") + t, F.lit(256)))
    weights = q.select("q_weight").distinct().withColumn("weight", F.explode(band))
    first = weights.join(F.broadcast(per), "weight").groupBy("q_weight").agg(F.sum("n").alias("in_band"))
    before = q.select("q_weight").distinct().join(F.broadcast(per), F.col("weight") < F.col("q_weight") - t, "left").groupBy("q_weight").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("start"))
    bands = before.join(first, "q_weight", "left").fillna(0)
    # tags near in the first word, by its segments
    # from 64 on, no first word is too far
    keys = lambda c: segment_keys(F.substring(c, 1, 16), 64, t + 1) if t < 64 else F.array(F.struct(F.lit(0).alias("segment"), F.lit(0).alias("value")))
    head = lambda df, c: df.withColumn("s", F.explode(keys(c)))
    x = head(tags, "tag").alias("r")
    y = head(q, "query_tag").alias("q")
    cut = [F.bit_count(F.col(f"r.{w}").bitwiseXOR(F.col(f"q.q_{w}"))) for w in WORDS]
    d = reduce(lambda a, b: a + b, cut)
    close = (F.col("r.s.segment") == F.col("q.s.segment")) & (F.col("r.s.value") == F.col("q.s.value")) & (cut[0] <= t) & (F.abs(F.col("r.weight") - F.col("q.q_weight")) <= t)
    near = x.join(y, close).select("q.query_tag", "r.tag", "r.weight", "r.place", "r.n", (cut[0] + cut[1]).alias("two"), d.alias("d")).distinct()
    near = materialise(near)
    hit = near.filter(F.col("d") <= t).groupBy("query_tag").agg(F.min(F.struct("place", "d", "weight")).alias("hit"))
    seen = near.join(hit, "query_tag", "left")
    extra = F.when(F.col("two") > t, 64).otherwise(192)
    # of a tag before the hit's weight all records are examined, of one in it those up to the hit's place
    whole = seen.filter(F.col("hit").isNull() | (F.col("weight") < F.col("hit.weight"))).select("query_tag", (F.col("n") * extra).alias("bits"))
    partly = seen.filter((F.col("weight") == F.col("hit.weight")) & (F.col("place") <= F.col("hit.place")))
    single = partly.filter("n = 1 or place = hit.place").select("query_tag", extra.cast("bigint").alias("bits"))
    several = partly.filter("n > 1 and place < hit.place").alias("p").join(placed.alias("r"), (F.col("p.tag") == F.col("r.tag")) & (F.col("r.place") <= F.col("p.hit.place")))
    several = several.select("p.query_tag", extra.cast("bigint").alias("bits"))
    more = whole.unionByName(single).unionByName(several).groupBy("query_tag").agg(F.sum("bits").alias("bits"))
    out = q.select("query_tag", "q_weight").join(F.broadcast(bands), "q_weight").join(hit, "query_tag", "left").join(more, "query_tag", "left")
    examined = F.when(F.col("hit").isNotNull(), F.col("hit.place") - F.col("start") + 1).otherwise(F.col("in_band"))
    best = F.when(F.col("hit").isNotNull(), F.col("hit.d")).when(F.col("in_band") > 0, t + 1).otherwise(257).cast("int")
    work = out.select(F.col("query_tag").alias("tag"), best.alias("best_distance"), F.col("hit").isNotNull().cast("int").alias("matched"), examined.cast("bigint").alias("records_examined"), (examined * 64 + F.coalesce("bits", F.lit(0))).cast("bigint").alias("bits_compared"))
    return queries.filter("tag is not null").select("query_id", "tag").join(work, "tag").drop("tag")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, rows) of rows that only one of two relations of the same columns has, repeated rows counting."""
    names = a.columns
    left = a.exceptAll(b.select(*names)).withColumn("side", F.lit("left"))
    return left.unionByName(b.select(*names).exceptAll(a).withColumn("side", F.lit("right")))
