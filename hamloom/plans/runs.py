"""Lookup experiments over a dataset: samples, searches at several thresholds, cross-checks, summaries and comparisons of runs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hamloom.functions import crypto
from hamloom.functions.text import RECOVERY_DOMAIN, TAG_DOMAIN, simhash
from hamloom.operators import experiment, protocol, search, stats
from hamloom.operators.skew import with_positions
from hamloom.session import materialise
from hamloom.sources.datasets import environment, sizes
from hamloom.sources.manifests import read_csv, read_tag_manifest
from hamloom.sources.sinks import changed, inventory, markdown, publish, write_csv, write_json_to

COUNTERS = ["candidate_count", "filter_queries", "inverted_lookups", "posting_records_read", "full_tag_distance_computations"]
COMPARATIVE = ["scheme", "threshold", "repeat", "query_id", "group", "latency_us", "matched", "best_distance", "records_examined", "bits_compared"]


def timed(make: Callable[[], DataFrame]) -> tuple[DataFrame, float]:
    """The written rows of a batch and the mean microseconds per row: a batch has no time of its own per query."""
    began = time.time()
    rows = materialise(make())
    return rows, (time.time() - began) * 1e6 / max(1, rows.count())


def comparative(records: DataFrame, queries: DataFrame, thresholds: list[int], repeats: int = 1, schemes: tuple[str, ...] = ("global_min", "first_match")) -> DataFrame:
    """The rows of COMPARATIVE (and `turn`, the order in which a query takes its thresholds) for queries (query_id, tag, group).

    The scan for the minimum is made once a repeat and decides every threshold. latency_us is the batch's mean, with three decimals.
    """
    if bad := [t for t in thresholds if not 0 <= t <= 256]:
        raise ValueError(f"thresholds {bad} are not within 0 and 256")
    placed = materialise(with_positions(queries.select("query_id", "group"), ["query_id"], "place"))
    out = None
    for repeat in range(repeats):
        least, spent = timed(lambda: search.global_min(records, queries, 0)) if "global_min" in schemes else (None, 0.0)
        for k, t in enumerate(thresholds):
            parts = []
            if least is not None:
                parts.append(least.withColumn("matched", (F.col("best_distance") <= t).cast("int")).withColumns({"scheme": F.lit("global_min"), "latency_us": F.lit(round(spent, 3))}))
            if "first_match" in schemes:
                rows, mean = timed(lambda t=t: search.first_match(records, queries, t))
                parts.append(rows.withColumns({"scheme": F.lit("first_match"), "latency_us": F.lit(round(mean, 3))}))
            for p in parts:
                p = p.withColumns({"threshold": F.lit(t), "repeat": F.lit(repeat), "_k": F.lit(k)})
                out = p if out is None else out.unionByName(p)
    at = out.join(placed, "query_id")
    # threshold k comes at the offset for which place + repeat + offset = k
    return at.withColumn("turn", stats.rotation(F.col("_k"), -F.col("repeat"), -F.col("place"), len(thresholds))).select(*COMPARATIVE, "turn")


def disagreements(exact: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, threshold): queries that the schemes don't decide alike. exact has (query_id, threshold, matched), rows those of COMPARATIVE."""
    both = exact.select("query_id", "threshold", "matched").unionByName(rows.select("query_id", "threshold", "matched"))
    return both.groupBy("query_id", "threshold").agg(F.countDistinct("matched").alias("n")).filter("n > 1").select("query_id", "threshold")


def run(spark: SparkSession, dataset: str, out: str, benchmark: int = 1000, pool: int | None = None, seed: int = 1, thresholds: str = "4,5,6", repeats: int = 1) -> dict:
    """A lookup experiment over a dataset of sources.datasets.prepare, published as one folder.

    Records are split into a query pool (a fifth by default) and the reference; a stratified sample of the pool is looked up by the
    index strategies at every threshold and by the two comparative schemes, whose decisions must agree. The folder has the samples,
    both result tables, their summaries as CSV and Markdown, an inventory of its files and the surroundings.
    """
    limits = [int(t) for t in thresholds.split(",")]
    tags = materialise(read_tag_manifest(spark, f"{dataset}/tags.csv"))
    bodies = read_csv(spark, f"{dataset}/manifest.csv", "id string, mailbox string, source_path string, body_sha256 string, body_size_bytes bigint, normalized_word_count bigint").select("id", "body_sha256")
    rows = materialise(tags.join(bodies, "id"))
    asked, reference = experiment.split(rows, "id", pool if pool is not None else rows.count() // 5, seed)
    asked, reference = materialise(asked), materialise(reference)
    labelled = materialise(experiment.exact_ref(asked, reference, "body_sha256"))
    bench, check = experiment.stratified(labelled, "id", benchmark, seed)
    queries = materialise(bench.withColumnRenamed("id", "query_id"))
    parts = []
    for t in limits:
        counted, mean = timed(lambda t=t: search.radius_counters(reference, queries, t))
        parts.append(counted.withColumns({"threshold": F.lit(t), "repeat": F.lit(0), "latency_us": F.lit(round(mean)).cast("bigint")}))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = materialise(found.join(queries.select("query_id", "group"), "query_id"))
    others = materialise(comparative(reference, queries, limits, repeats))
    # the comparative schemes don't regard types, so they are held against the index without types
    plain = lambda df: df.withColumn("type", F.lit("any"))
    hits = None
    for t in limits:
        h = search.radius_exact(plain(reference), plain(queries), f"default={t}").select(F.col("query_tag").alias("tag")).distinct().withColumn("matched", F.lit(1))
        one = queries.select("query_id", "tag").join(h, "tag", "left").select("query_id", F.lit(t).alias("threshold"), F.coalesce("matched", F.lit(0)).alias("matched"))
        hits = one if hits is None else hits.unionByName(one)
    wrong = disagreements(hits, others).orderBy("threshold", "query_id").take(1)
    if wrong:
        raise ValueError(f"query {wrong[0]['query_id']!r} is decided in two ways at threshold {wrong[0]['threshold']}")
    by_strategy = materialise(stats.summarise(found, "strategy", "threshold", "group", "query_id", "latency_us", F.col("candidate_count") > 0, COUNTERS))
    by_scheme = materialise(stats.summarise(others, "scheme", "threshold", "group", "query_id", "latency_us", F.col("matched") == 1, ["best_distance", "records_examined", "bits_compared"]))

    def write(at: str) -> None:
        write_csv(queries, f"{at}/queries.csv", ["query_id", "type", "tag"])
        write_csv(check, f"{at}/queries_verify.csv", ["id", "type", "tag"])
        write_csv(queries.withColumn("source_id", F.col("query_id")), f"{at}/labels.csv", ["query_id", "group", "body_sha256", "source_id"])
        write_csv(found.orderBy("strategy", "threshold", "query_id"), f"{at}/index.csv", ["strategy", "threshold", "query_id", "type", "group", "repeat", "latency_us", *COUNTERS])
        write_csv(others.orderBy("scheme", "repeat", "query_id", "turn"), f"{at}/comparative.csv", COMPARATIVE)
        write_csv(by_strategy.orderBy("scheme", "threshold", "group"), f"{at}/summary_index.csv", by_strategy.columns)
        write_csv(by_scheme.orderBy("scheme", "threshold", "group"), f"{at}/summary_comparative.csv", by_scheme.columns)
        text = "# Index strategies\n\n" + markdown(by_strategy.orderBy("scheme", "threshold", "group")) + "\n# Comparative schemes\n\n" + markdown(by_scheme.orderBy("scheme", "threshold", "group"))
        write_json_to(spark, {"report": text}, f"{at}/report.json")
        write_json_to(spark, environment(spark), f"{at}/environment.json")
        seal(spark, at)

    publish(spark, out, write)
    return {"queries": queries.count(), "reference": reference.count(), "thresholds": limits}


def seal(spark: SparkSession, folder: str) -> None:
    """Add an inventory of a folder's files, by which check() tells whether they are still the same."""
    listed = materialise(inventory(spark, folder))
    write_csv(listed.orderBy("path"), f"{folder}/inventory", ["path", "length", "sha256"])


def check(spark: SparkSession, folder: str) -> DataFrame:
    """(path, problem) of a sealed folder's files that are missing, unlisted or changed."""
    listed = read_csv(spark, f"{folder}/inventory", "path string, length bigint, sha256 string")
    now = inventory(spark, folder).filter(~F.startswith("path", F.lit("inventory/")) & ~F.col("path").rlike(r"(^|/)[._][^/]*\z"))
    return changed(now, listed.filter(~F.col("path").rlike(r"(^|/)[._][^/]*\z")))


def analyse(spark: SparkSession, a: str, b: str, out: str) -> dict:
    """Compare the index results of two sealed runs of the same queries: row by row, latencies, and agreement of the counters."""
    for folder in (a, b):
        if bad := check(spark, folder).take(1):
            raise ValueError(f"{bad[0]['path']} of {folder} is {bad[0]['problem']}")
    schema = "strategy string, threshold int, query_id string, type string, `group` string, repeat int, latency_us bigint, " + ", ".join(f"{c} bigint" for c in COUNTERS)
    left, right = (materialise(read_csv(spark, f"{x}/index.csv", schema)) for x in (a, b))
    keys = ["strategy", "threshold", "query_id", "repeat"]
    met = left.join(right, keys, "full_outer").select(F.count_if(left["latency_us"].isNull() | right["latency_us"].isNull())).first()[0]
    if met:
        raise ValueError(f"{met} results are in one run only")
    rows = materialise(stats.run_comparison(left, right, keys, "latency_us", COUNTERS))
    latency = stats.latency_comparison(left, right, ["strategy", "threshold"], "latency_us")
    agree = stats.agreement(left, right, keys, COUNTERS)

    def write(at: str) -> None:
        write_csv(rows.orderBy(*keys), f"{at}/comparison.csv", rows.columns)
        write_csv(latency.orderBy("strategy", "threshold"), f"{at}/latency.csv", latency.columns)
        write_csv(agree.orderBy("metric"), f"{at}/workload.csv", agree.columns)
        parts = [sizes(spark, x).withColumn("run", F.lit(n)).collect() for n, x in (("a", a), ("b", b))]  # a row per file of a run
        write_json_to(spark, {"sizes": [r.asDict() for p in parts for r in p], "environment": environment(spark)}, f"{at}/surroundings.json")

    publish(spark, out, write)
    return {"rows": rows.count(), "disagreements": rows.filter("workload_match = 0").count()}


def _steps() -> dict[str, Callable[[bytes], object]]:
    """Parts of the protocol by name, each a function of a text."""
    pad = lambda x: crypto.pad_stream(x, 90)
    made = crypto.extract_new(simhash(b"a b c d", RECOVERY_DOMAIN), pad(b"seed"))
    key = b"\x07" * 32
    vk, signed = crypto.public_key(key), crypto.sign(key, b"message")
    return {
        "tag": lambda t: simhash(t, TAG_DOMAIN),
        "extract": lambda t: crypto.extract_new(simhash(t, RECOVERY_DOMAIN), pad(t)),
        "recover": lambda t: crypto.extract_again(simhash(b"a b c d", RECOVERY_DOMAIN), made[1]),
        "sign": lambda t: crypto.sign(key, t),
        "verify": lambda t: crypto.verify(vk, b"message", signed),
        "convergent": lambda t: crypto.convergent(key, t),
        "transfer": lambda t: crypto.transfer_keys(crypto.transfer_offer(t), crypto.transfer_choose(key, crypto.transfer_offer(t)[1], 1)[0]),
    }


def benchmark(rounds: int = 3, text: bytes = b"the harbour lights fade slowly over the quay " * 20) -> dict[str, float]:
    """Mean microseconds a round of every part of the protocol, on this machine alone."""
    out = {}
    for name, step in _steps().items():
        began = time.perf_counter()
        for k in range(rounds):
            step(text + str(k).encode())
        out[name] = round((time.perf_counter() - began) * 1e6 / max(1, rounds), 3)
    return out


def self_test(spark: SparkSession) -> dict[str, bool]:
    """Whether the parts of upload, proof, transfer and search work here, on a few small inputs."""
    docs = spark.createDataFrame([("r", "text", bytearray(b"one two three four five"))], "rid string, type string, content binary")
    stored = protocol.first_upload(docs, "seed")
    claims = stored.join(docs.select("rid", "content"), "rid").selectExpr("*", "'u' AS uid", "unhex('00') AS token")
    got = protocol.recover(protocol.prove(claims)).first()
    rows = spark.createDataFrame([("x", bytearray(b"left"), bytearray(b"right"), 1)], "ident string, first binary, second binary, choice int")
    tags = spark.createDataFrame([(0, "t", "0" * 64), (1, "t", "f" * 64)], "record_id long, type string, tag string")
    asked = spark.createDataFrame([("q", "t", "0" * 63 + "7")], "query_id string, type string, tag string")
    ways = [{tuple(r) for r in f(tags, asked).collect()} for f in (search.radius_scan, search.radius_exact, search.radius_prefuzz)]
    secret = spark.range(1).select(protocol.join_shares(protocol.share_secret(F.lit(5).cast("bigint"), F.array(F.lit("a"), F.lit("b")), "s"), F.array(F.lit("a"), F.lit("b"))).alias("s")).first()["s"]
    return {
        "ownership": bool(got["proven"]) and bytes(got["file"]) == b"one two three four five",
        "transfer": bytes(protocol.transfer(rows, "seed").first()["received"]) == b"right",
        "search": ways[0] == ways[1] == ways[2] and len(ways[0]) == 1,
        "shares": secret == 5,
    }
