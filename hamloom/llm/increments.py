"""New batches against everything accepted before, through bucketed tables of content hashes and segment hashes."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hamloom.functions.bits import WORDS, hamming, segment_keys, with_words, words_of
from hamloom.functions.keys import hex256, norm_name
from hamloom.operators.store import manifest_once, record_tags
from hamloom.operators.skew import lookup_unique
from hamloom.session import drop_dir, materialise, shared_dir, table

RADIUS = 6


def _segments(df: DataFrame, radius: int) -> DataFrame:
    """One row per (type, segment, value) of every tag: the paragraphs of a tag are its radius + 1 bit segments."""
    keys = segment_keys("tag", 256, radius + 1)
    return df.withColumn("s", F.explode(keys)).select("*", F.concat_ws("/", "type", "s.segment", F.hex("s.value")).alias("part")).drop("s")


class History:
    """Everything accepted so far, as two bucketed tables in a folder that all executors share.

    `whole` has the content hashes (digests), bucketed by digest; `parts` has every distinct tag once per segment, bucketed by
    (type, segment, value). A batch is shuffled to the buckets by itself; the tables are read bucket by bucket where
    they lie and aren't shuffled again. append() adds the accepted records of a batch as further files of the buckets, so
    the history is never rewritten; an append that broke off is repeated whole, as hashes that come twice do no harm.
    buckets is fixed when the history begins: about one bucket per 128 MB expected.

    With a path, the history stays there: another session opens it by the same path, with the buckets and the radius it was
    begun with. Without one it lies in a folder of its own until close().
    """

    def __init__(self, spark: SparkSession, buckets: int = 16, radius: int = RADIUS, path: str | None = None):
        self.spark, self.kept = spark, path is not None
        self.dir = path.rstrip("/") if path else shared_dir(spark)
        self.buckets, self.radius = self._begin(buckets, radius)
        name = hashlib.sha256(self.dir.encode()).hexdigest()[:16]
        self.whole, self.parts = f"hamloom_whole_{name}", f"hamloom_parts_{name}"
        words = ", ".join(f"{w} bigint" for w in WORDS)
        for table_name, columns, key in ((self.whole, "digest string", "digest"), (self.parts, f"part string, {words}", "part")):
            at = f"{self.dir}/{table_name[:13]}"
            spark.sql(f"CREATE TABLE IF NOT EXISTS {table_name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{at}'")

    def _begin(self, buckets: int, radius: int) -> tuple[int, int]:
        """The buckets and radius of the folder, which are written there when the history begins."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.dir}/history.json")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(at):
            kept = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.dir}/history.json").collect()))
            return kept["buckets"], kept["radius"]
        out = fs.create(at, False)
        out.write(bytearray(json.dumps({"buckets": buckets, "radius": radius}).encode()))
        out.close()
        return buckets, radius

    def append(self, accepted: DataFrame) -> None:
        """Add records (digest, type, tag); a null digest or tag adds nothing to its table."""
        digests = accepted.select("digest").filter("digest is not null").distinct()
        tags = accepted.select("type", "tag").filter("tag is not null and type is not null").distinct()
        for df, key, name in ((digests, "digest", self.whole), (_segments(with_words(tags), self.radius).select("part", *WORDS), "part", self.parts)):
            # one file per bucket and append
            df.repartition(self.buckets, key).sortWithinPartitions(key).write.insertInto(name)
            self.spark.catalog.refreshTable(name)

    def known(self, batch: DataFrame) -> DataFrame:
        """The ids of batch (id, digest, type, tag) with a known digest, or a tag within radius of a known one of its type.

        Only distinct digests and tags of the batch are compared; a hot one costs as much as any other.
        """
        digests = batch.filter("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
        full = digests.join(self.spark.table(self.whole), "digest", "left_semi").select("digest", F.lit(True).alias("_hit"))
        tags = batch.filter("tag is not null and type is not null").groupBy("type", "tag").agg(F.count(F.lit(1)).alias("n"))
        a = _segments(with_words(tags.select("type", "tag")), self.radius).alias("a")
        b = self.spark.table(self.parts).alias("b")
        close = (F.col("a.part") == F.col("b.part")) & (hamming(words_of(alias="a"), words_of(alias="b")) <= self.radius)
        near = a.join(b, close, "left_semi").select("type", "tag").distinct().withColumn("_hit", F.lit(True))
        by_digest = lookup_unique(batch.filter("digest is not null").select("id", "digest"), full, ["digest"], digests).filter("_hit").select("id")
        by_tag = lookup_unique(batch.filter("tag is not null and type is not null").select("id", "type", "tag"), near, ["type", "tag"], tags).filter("_hit").select("id")
        return by_digest.union(by_tag).distinct()

    def add(self, batch: DataFrame) -> DataFrame:
        """Settle a batch (id, pos, digest, type, tag): (id, repeat) of every record, all others being appended.

        repeat is true if the history or an earlier record of the batch (by pos) that is no repeat has the same digest, or a
        tag of the same type within radius. The verdicts are a written table.
        """
        new = materialise(batch.select("id", "pos", "digest", "type", "tag"))
        old = materialise(self.known(new))
        rest = new.join(old, "id", "left_anti")
        verdicts = materialise(first_of_each(rest, self.radius).union(old.select("id", F.lit(True).alias("repeat"))))
        self.append(new.join(verdicts.filter("not repeat"), "id", "left_semi"))
        return verdicts

    def close(self) -> None:
        """Forget both tables; their files go too unless the history was given a path."""
        for t in (self.whole, self.parts):
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        if not self.kept:
            drop_dir(self.spark, self.dir)


def first_of_each(rest: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(id, repeat) for records (id, pos, digest, type, tag) in order of pos: repeat is true if an earlier record that is
    no repeat itself has the same digest, or a tag of the same type within radius.

    Records equal in digest, type and tag are repeats of the first of them whatever becomes of it, so only firsts are
    compared. Their links are kept as keys (digests, and tags with their neighbours), never as pairs of records. A round
    accepts every open record that is the first open one at all of its keys and sees no accepted record there, and
    rejects those that see one. What is settled leaves the tables of open records, and rounds go on until these are empty:
    every round settles the first open record at least, so they end. pos is unique.
    """
    rest = materialise(rest.select("id", "pos", "digest", "type", "tag"))
    bare = rest.filter("digest is null and (tag is null or type is null)")
    keyed = rest.filter("digest is not null or (tag is not null and type is not null)")
    keys = ["digest", "type", "tag"]
    firsts = materialise(keyed.groupBy(*keys).agg(F.min("pos").alias("pos")))
    tags = firsts.filter("tag is not null and type is not null").select("type", "tag").distinct()
    parts = _segments(with_words(tags), radius)
    a, b = parts.alias("a"), parts.alias("b")
    close = (F.col("a.part") == F.col("b.part")) & (hamming(words_of(alias="a"), words_of(alias="b")) <= radius)
    # every tag is its own neighbour, for it shares all segments with itself
    near = a.join(b, close).select("a.type", "a.tag", F.col("b.tag").alias("near")).distinct()
    tagged = firsts.filter("type is not null and tag is not null")
    yes = F.lit(True).alias("gives")
    # a record gives its own keys and sees these and the tags near its own
    digests = firsts.filter("digest is not null").select("pos", F.concat(F.lit("d"), "digest").alias("key"), yes)
    seen = tagged.join(near, ["type", "tag"]).select("pos", F.concat_ws("/", F.lit("t"), "type", "near").alias("key"), (F.col("near") == F.col("tag")).alias("gives"))
    open_ = materialise(digests.union(seen).withColumn("taken", F.lit(None).cast("bigint")))
    done: DataFrame | None = None
    rounds = 0
    while True:
        waiting = open_.filter("gives").groupBy("key").agg(F.min("pos").alias("open"))
        state = open_.join(waiting, "key", "left").groupBy("pos").agg(F.coalesce(F.max(F.col("taken") < F.col("pos")), F.lit(False)).alias("repeat"), F.min("open").alias("open"))
        now = materialise(state.filter(F.col("repeat") | (F.col("open") >= F.col("pos"))).select("pos", "repeat"))
        done, rounds = now if done is None else done.unionByName(now), rounds + 1
        if rounds % 20 == 0:
            done = materialise(done)
        fresh = open_.filter("gives").join(now.filter("not repeat").select("pos"), "pos", "left_semi").groupBy("key").agg(F.min("pos").alias("fresh"))
        left = open_.join(now.select("pos"), "pos", "left_anti").join(fresh, "key", "left")
        open_ = materialise(left.select("pos", "key", "gives", F.least("taken", "fresh").alias("taken")))
        if open_.isEmpty():
            break
    # of the firsts the rounds decide; any other record with the same keys is a repeat
    out = keyed.select("id", "pos").join(done, "pos", "left").select("id", F.coalesce("repeat", F.lit(True)).alias("repeat"))
    return out.union(bare.select("id", F.lit(False).alias("repeat")))


def arrivals(spark, sf_dir: str) -> DataFrame:
    """(id, batch_no, digest, type, tag) of queries_verify_100, one row per id (of repeated rows the earliest batch)."""
    q = table(spark, sf_dir, "queries_verify_100").select("id", "batch_no", norm_name("type").alias("type"), hex256("tag_hex").alias("tag"))
    q = q.groupBy("id").agg(F.min("batch_no").alias("batch_no"), F.max("type").alias("type"), F.max("tag").alias("tag"))
    m = manifest_once(spark, sf_dir).select("id", "digest")
    return q.join(m, "id", "left")


#: Loads in which p3's arrivals are taken: whole batches in order, of about as many records each.
LOADS = 3


def p3_verdicts(spark, sf_dir: str, radius: int = RADIUS, loads: int = LOADS) -> DataFrame:
    """(id, repeat) of every arriving record.

    The reference records begin a history; the arrivals come to it in loads of whole batches, in order. Each is looked up in the
    history as it is then, its new records are appended, and the next load meets them there.
    """
    history = History(spark, radius=radius)
    m = manifest_once(spark, sf_dir).filter("role = 'reference'")
    tags = record_tags(spark, sf_dir)
    none = F.lit(None).cast("string")
    history.append(m.select("digest", none.alias("type"), none.alias("tag")).unionByName(tags.select(none.alias("digest"), "type", "tag")))
    new = with_positions(arrivals(spark, sf_dir), ["batch_no", "id"])
    sizes = new.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n"))  # one row per batch
    # a batch belongs to the load in which its middle record lies
    place = F.sum("n").over(W.orderBy(F.col("batch_no").asc_nulls_first())) - F.col("n") / 2
    total = F.sum("n").over(W.partitionBy())
    of = sizes.withColumn("load", F.floor(place * F.lit(loads) / total)).select("batch_no", "load")
    new = materialise(new.alias("l").join(F.broadcast(of).alias("r"), F.col("l.batch_no").eqNullSafe(F.col("r.batch_no"))).select("l.*", "r.load"))
    out = None
    for load in range(loads):
        verdicts = history.add(new.filter(F.col("load") == load))
        out = verdicts if out is None else out.unionByName(verdicts)
    history.close()
    return out


def with_positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Add pos, numbers from 0 in the given total order: range partitions, their sizes, and places within them."""
    spark = df.sparkSession
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialise(cut.withColumn("_at", F.monotonically_increasing_id()))
    # the number's upper bits are the partition's, its lower 33 the place within it
    part = F.shiftright("_at", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per partition
    offset, starts = 0, {}
    for r in sorted(sizes, key=lambda r: r["_part"]):
        starts[r["_part"]], offset = offset, offset + r["n"]
    if not starts:
        return numbered.drop("_at").withColumn("pos", F.lit(0).cast("bigint"))
    first = spark.createDataFrame(list(starts.items()), "_part bigint, _first bigint")
    return numbered.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn("pos", F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_first")


def p3_found(spark, sf_dir: str, radius: int = RADIUS) -> DataFrame:
    """Arriving records that bring nothing new."""
    return p3_verdicts(spark, sf_dir, radius).filter("repeat").select("id")
