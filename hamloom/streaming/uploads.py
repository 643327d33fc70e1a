"""Uploads that arrive as a stream, and one-time challenges that expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hamloom.functions.text import RECOVERY_DOMAIN, TAG_DOMAIN, parse_thresholds, text_tag
from hamloom.operators import filters
from hamloom.operators.greedy import assign
from hamloom.operators.protocol import references
from hamloom.operators.search import posting_rows
from hamloom.session import materialise, widen
from hamloom.sources.sinks import read_json, write_json_to

#: Seconds for which a challenge may be answered.
TTL = 120


class UploadStore:
    """Stored representatives and decisions as Parquet; each micro-batch adds one folder of either, named by its number, so a
    batch that is run again after a failure replaces its own output and nothing else.

    config.json has the thresholds, the filters' false positive rate and the number of records that the filters of a type are made for.
    It is written by the first setup and changed by later ones; see setup().
    """

    def __init__(self, spark: SparkSession, path: str, spec: str | None = None, capacity: int = 1000, fpp: float = 0.01):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = "id string, pos bigint, type string, tag string, recovery string"
        self.config = read_json(spark, f"{self.path}/config.json")
        if self.config is None:
            self.setup(spec or "default=6", capacity, fpp)
        elif spec is not None and parse_thresholds(spec) != parse_thresholds(self.config["spec"]):
            self.setup(spec, self.config["capacity"], self.config["fpp"])
        self.spec = self.config["spec"]

    def setup(self, spec: str, capacity: int, fpp: float) -> None:
        """Set thresholds, capacity and false positive rate; with records stored, other thresholds or less capacity than they need fail."""
        limits = parse_thresholds(spec)
        filters.sizing(capacity, fpp)
        if self.config is not None and (counts := self.counts()):
            if parse_thresholds(self.config["spec"]) != limits:
                raise ValueError("thresholds can't change once records are stored")
            if capacity < max(counts.values()):
                raise ValueError(f"a capacity of {capacity} is less than the {max(counts.values())} stored records of a type")
        kept = {} if self.config is None else self.config.get("capacities", {})
        self.config = {"spec": spec, "capacity": capacity, "fpp": fpp, "capacities": {t: max(capacity, n) for t, n in kept.items()}}
        self.spec = spec
        write_json_to(self.spark, self.config, f"{self.path}/config.json")

    def counts(self) -> dict[str, int]:
        """Stored records by type: one number each."""
        return {r["type"]: r["n"] for r in self.stored().groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}

    def grow(self) -> dict[str, int]:
        """Double the capacity of types that have reached theirs, as often as needed; returns all capacities. Runs before a batch's records become visible."""
        sizes = dict(self.config.get("capacities", {}))
        for kind, n in self.counts().items():
            sizes[kind] = max(sizes.get(kind, 0), self.config["capacity"])
            while sizes[kind] <= n:
                sizes[kind] *= 2
        if sizes != self.config.get("capacities", {}):
            self.config["capacities"] = sizes
            write_json_to(self.spark, self.config, f"{self.path}/config.json")
        return sizes

    def filter_entries(self) -> DataFrame:
        """The membership filters' entries (type, segment, bin, mini, spare) of all stored records at their type's capacity.

        A type with more records than its capacity fails; grow() prevents it.
        """
        sizes, counts = self.config.get("capacities", {}), self.counts()
        if over := [t for t, n in counts.items() if n > sizes.get(t, self.config["capacity"])]:
            raise ValueError(f"more records than capacity: {sorted(over)}")
        rows = posting_rows(self.stored().withColumn("record_id", F.lit(0).cast("bigint")), self.spec).select("type", "segment", "value")
        capacity = self.spark.createDataFrame([(t, int(sizes.get(t, self.config["capacity"]))) for t in counts], "type string, n bigint")
        return filters.filter_entries(rows, capacity, self.config["fpp"])

    def stored(self, before: int | None = None) -> DataFrame:
        """Representatives, of the batches before a number if given."""
        rows = self._read("stored", self.schema)
        return (rows if before is None else rows.filter(F.col("batch") < before)).drop("batch")

    def decisions(self) -> DataFrame:
        return self._read("decisions", "id string, uid string, pos bigint, rid string, distance int, stored boolean")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema + ", batch bigint").parquet(f"{self.path}/{name}")
        except Exception as e:  # nothing has been stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema + ", batch bigint")

    def refs(self, uid: str | None = None) -> DataFrame:
        """(uid, rid, created, type, tag): the representatives that users refer to, once each, with the stored record."""
        made = self.decisions().filter("uid is not null")
        made = made if uid is None else made.filter(F.col("uid") == uid)
        once = references(made.select("uid", "rid", F.col("pos").alias("created")))
        return once.join(self.stored().select(F.col("id").alias("rid"), "type", "tag"), "rid").select("uid", "rid", "created", "type", "tag")

    def record(self, rid: str) -> DataFrame:
        """The stored record of one rid: none or one row."""
        return self.stored().filter(F.col("id") == rid)

    def next(self) -> tuple[int, int]:
        """The number of the next batch, and the first position after all decided uploads."""
        row = self.decisions().agg(F.max("batch").alias("b"), F.max("pos").alias("p")).first()
        return (0 if row["b"] is None else row["b"] + 1), (0 if row["p"] is None else row["p"] + 1)

    def add(self, batch: DataFrame, number: int) -> None:
        """Decide a batch (id, pos, type, content string, uid if any): reuse the nearest of the stored representatives and the earlier
        uploads that are stored, by (distance, pos), else store. ids are unique over all batches, and pos grows from batch to batch.

        The batch is compared with the stored representatives and with itself; these aren't compared with one another. Where the
        batches are cut makes no difference to the decisions. Null contents and types are left out.
        """
        uid = F.col("uid") if "uid" in batch.columns else F.lit(None).cast("string")
        raw = materialise(widen(batch).select("id", "pos", uid.alias("uid"), "type", text_tag("content", TAG_DOMAIN).alias("tag"), text_tag("content", RECOVERY_DOMAIN).alias("recovery")))
        rows = raw.filter("tag is not null and type is not null")
        out = assign(rows.drop("uid"), self.spec, self.stored(number))
        made = materialise(rows.select("id", "uid", "pos").join(out, "id").select("id", "uid", "pos", "rid", "distance", "stored"), f"{self.path}/decisions/batch={number}")
        rows.join(made.filter("stored").select("id"), "id", "left_semi").select("id", "pos", "type", "tag", "recovery").write.mode("overwrite").parquet(f"{self.path}/stored/batch={number}")
        self.grow()

    def start(self, uploads: DataFrame, checkpoint: str) -> StreamingQuery:
        """Run add on every micro-batch of a stream."""
        return uploads.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.add).start()


CHALLENGE_OUT = T.StructType([T.StructField("token", T.StringType()), T.StructField("uid", T.StringType()), T.StructField("accepted", T.BooleanType()), T.StructField("reason", T.StringType())])
_STATE = T.StructType([T.StructField("uid", T.StringType()), T.StructField("expires", T.LongType()), T.StructField("used", T.BooleanType())])


def _answer(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One token's events in order of time; the first answer uses it up whatever comes of it."""
    if state.hasTimedOut:
        state.remove()
        return
    events = pd.concat(list(batches)).sort_values(["at", "kind"], ascending=[True, False], kind="stable")
    uid, expires, used = state.get if state.exists else (None, None, False)
    out = []
    for e in events.itertuples():
        if e.kind == "issue":
            if uid is None:
                uid, expires, used = e.uid, int(e.at) + TTL, False
            continue
        reason = "unknown" if uid is None else "used" if used else "expired" if e.at > expires else "another user" if e.uid != uid else "bad signature" if not e.valid else ""
        used = used or uid is not None
        out.append((key[0], e.uid, reason == "", reason))
    if uid is not None:
        state.update((uid, expires, used))
        state.setTimeoutDuration(2 * TTL * 1000)
    yield pd.DataFrame(out, columns=["token", "uid", "accepted", "reason"])


def challenges(events: DataFrame) -> DataFrame:
    """(token, uid, accepted, reason) per answer in a stream (token, kind issue or answer, uid, at epoch seconds, valid).

    An answer is accepted once, from the user the token was issued to, within TTL seconds, with a valid signature. The state
    of a token is dropped when nothing has come for twice that time.
    """
    return events.groupBy("token").applyInPandasWithState(_answer, CHALLENGE_OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def answer_challenges(events: DataFrame) -> DataFrame:
    """The rows of challenges for a finished table of events, by one aggregate and one window over each token's answers."""
    issued = events.filter("kind = 'issue'").groupBy("token").agg(F.min(F.struct("at", "uid")).alias("i"))
    rows = events.filter("kind = 'answer'").join(issued, "token", "left").withColumn("known", F.coalesce(F.col("i.at") <= F.col("at"), F.lit(False)))
    turn = F.row_number().over(W.partitionBy("token", "known").orderBy("at"))
    reason = F.when(~F.col("known"), "unknown").when(F.col("turn") > 1, "used").when(F.col("at") > F.col("i.at") + TTL, "expired").when(F.col("uid") != F.col("i.uid"), "another user").when(~F.col("valid"), "bad signature").otherwise("")
    return rows.withColumn("turn", turn).withColumn("reason", reason).select("token", "uid", (F.col("reason") == "").alias("accepted"), "reason")
