"""A persistent inverted index of tags that is reused while its signature holds."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hamloom.functions.bits import weight, with_words, words_of
from hamloom.functions.text import parse_thresholds
from hamloom.operators.search import posting_rows


def signature(records: DataFrame, spec: str, bits: int = 256) -> str:
    """A hash over the format, the thresholds and all records whatever their order."""
    mark = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("record_id").cast("string"), "type", "tag").cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    row = records.select(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(mark), F.lit(0)).cast("string").alias("s")).first()
    limits = ",".join(f"{k}={v}" for k, v in sorted(parse_thresholds(spec).items()))
    return f"tags-3|{bits}|{limits}|{row['n']}|{row['s']}"


class TagIndex:
    """Records and their postings as Parquet below a folder; postings are cut by hash of type, segment and value, and sorted by these.

    build() writes both, then the signature, so that a broken build is never taken for an index. open() reuses the folder if
    signature and row counts hold, and builds it otherwise.
    """

    def __init__(self, spark: SparkSession, path: str, spec: str = "default=6"):
        self.spark, self.path, self.spec = spark, path.rstrip("/"), spec
        self.reused = False

    def _file(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/signature.json")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def open(self, records: DataFrame) -> TagIndex:
        """Use or make the index of records (record_id, type, tag)."""
        records = records.filter("tag is not null and type is not null")
        want = signature(records, self.spec)
        at, fs = self._file()
        if fs.exists(at):
            kept = json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/signature.json").collect()))
            if kept["signature"] == want and self.records().count() == kept["records"] and self.postings().count() == kept["postings"]:
                self.reused = True
                return self
        self.build(records, want)
        return self

    def build(self, records: DataFrame, mark: str) -> None:
        at, fs = self._file()
        fs.delete(at, False)
        records.write.mode("overwrite").parquet(f"{self.path}/records")
        rows = posting_rows(self.records(), self.spec)
        # as many tasks as the session's shuffles have: a lookup prunes by the row groups' ranges of type, segment and value
        rows.repartition("type", "segment", "value").sortWithinPartitions("type", "segment", "value").write.mode("overwrite").parquet(f"{self.path}/postings")
        text = json.dumps({"signature": mark, "records": self.records().count(), "postings": self.postings().count()})
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.reused = False

    def records(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/records")

    def postings(self) -> DataFrame:
        return self.spark.read.schema("type string, segment bigint, value binary, record_id bigint").parquet(f"{self.path}/postings")

    def lookup(self, kind: str, segment: int, value: bytes) -> DataFrame:
        """(record_id) of the postings of one segment value: row groups are pruned by their ranges."""
        at = self.postings().filter((F.col("type") == kind) & (F.col("segment") == segment) & (F.col("value") == F.lit(value)))
        return at.select("record_id")

    def record(self, record_id: int) -> DataFrame:
        """The record of one number: none or one row."""
        return self.records().filter(F.col("record_id") == record_id)


class WeightBlocks:
    """Records by the weight of their tags, as Parquet with a folder per weight; always built anew.

    A query of weight w at threshold t reads the folders from w - t to w + t only; all() reads every one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, records: DataFrame) -> WeightBlocks:
        """Write records (record_id, tag); null tags are left out. A weight's records are cut into files by the session's shuffle."""
        rows = with_words(records.filter("tag is not null").select("record_id", "tag")).withColumn("weight", weight(words_of()).cast("int"))
        rows.select("record_id", "tag", "weight").repartition("weight", F.pmod("record_id", F.lit(8))).write.mode("overwrite").partitionBy("weight").parquet(self.path)
        return self

    def all(self) -> DataFrame:
        return self.spark.read.schema("record_id bigint, tag string, weight int").parquet(self.path)

    def band(self, low: int, high: int) -> DataFrame:
        """Records of the weights low to high."""
        return self.all().filter(F.col("weight").between(low, high))

    def blocks(self) -> DataFrame:
        """(label, records): "all" and one row per weight that has records."""
        per = self.all().groupBy("weight").agg(F.count(F.lit(1)).alias("n"))
        return per.select(F.explode(F.array(F.lit("all"), F.col("weight").cast("string"))).alias("label"), "n").groupBy("label").agg(F.sum("n").alias("records"))
