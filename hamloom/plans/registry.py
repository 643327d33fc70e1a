"""Queries of the core by name, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hamloom.functions import crypto
from hamloom.functions.bits import distance_until, weight, with_words, words_of
from hamloom.functions.keys import hex256, norm_name
from hamloom.functions.text import RECOVERY_DOMAIN, extract_body, metadata_line, normalised, parse_thresholds, simhash, text_tag, threshold_for, typed_value, words
from hamloom.operators import experiment, filters, greedy, heavy_keys, media, protocol, search, similarity, stats, text_sets
from hamloom.operators.index import WeightBlocks, signature
from hamloom.operators.skew import with_positions
from hamloom.operators.store import manifest_once, record_tags
from hamloom.session import materialise, shared_dir, table, widen
from hamloom.streaming.uploads import UploadStore, answer_challenges

DELTA = 6
SPEC = "default=6,text=4,video=8"
SEED, BENCHMARK, POOL, PAIRS = 20250101, 200, 1000, 10_000
COUNTERS = ["candidate_count", "filter_queries", "inverted_lookups", "posting_records_read", "full_tag_distance_computations"]


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a text; a null one has no words, tag or digest. What is done per text costs more than dealing the texts out."""
    return widen(table(spark, sf, "documents")).filter("text is not null")


def records(spark: SparkSession, sf: str) -> DataFrame:
    """(record_id, type, tag) with a readable tag."""
    return record_tags(spark, sf).filter("tag is not null and type is not null")


def arriving(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, type, tag) of the arriving records, one row per id."""
    q = table(spark, sf, "queries_verify_100")
    return q.groupBy(F.col("id").alias("query_id")).agg(F.max(norm_name("type")).alias("type"), F.max(hex256("tag_hex")).alias("tag"))


def untyped(df: DataFrame) -> DataFrame:
    return df.withColumn("type", F.lit("any"))


def measured(spark: SparkSession, sf: str) -> DataFrame:
    """prefuzz_verify with clean names, one row per measurement; latency is null when nothing was measured."""
    t = table(spark, sf, "prefuzz_verify")
    keys = ["run_id", "strategy", "type", "query_id", "repeat"]
    clean = t.withColumns({"strategy": norm_name("strategy"), "type": norm_name("type"), "latency_us": F.when(F.col("latency_us") >= 0, F.col("latency_us"))})
    return clean.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("latency_us", "candidate_count", "filter_queries", "inverted_lookups", "posting_records_read", "full_tag_distance_computations")])


def text_tags(spark, sf):
    """Similarity tag of every text."""
    return documents(spark, sf).select("doc_id", text_tag("text").alias("tag"))


def recovery_tags(spark, sf):
    """Recovery representation of every text."""
    return documents(spark, sf).select("doc_id", text_tag("text", RECOVERY_DOMAIN).alias("tag"))


def normalized_tags(spark, sf):
    """Tag, number and first of the documents of every distinct normalised text; each is tagged once."""
    n = documents(spark, sf).select("doc_id", normalised("text").alias("body")).groupBy("body").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"))
    return n.select(F.sha2("body", 256).alias("normalized_sha256"), "documents", "first_doc", text_tag("body").alias("tag"))


def word_counts(spark, sf):
    """Number of words and normalised length of every text."""
    return documents(spark, sf).select("doc_id", F.size(words("text")).cast("bigint").alias("word_count"), F.length(normalised("text")).cast("bigint").alias("chars"))


def body_extract(spark, sf):
    """Digest and length of the body after a mail header; the text itself is the mail, null without a blank line."""
    body = extract_body("text")
    return documents(spark, sf).select("doc_id", F.sha2(body, 256).alias("body_sha256"), F.octet_length(body).cast("bigint").alias("body_bytes"))


def corpus_totals(spark, sf):
    """Documents, words, bytes and texts without a word."""
    n = F.size(words("text"))
    return documents(spark, sf).agg(F.count(F.lit(1)).alias("documents"), F.sum(n).cast("bigint").alias("words"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes"), F.count_if(n == 0).alias("empty"), F.max(n).cast("bigint").alias("longest"))


def tag_weights(spark, sf):
    """Records per weight of their tag."""
    return with_words(records(spark, sf)).groupBy(weight(words_of()).cast("int").alias("weight")).agg(F.count(F.lit(1)).alias("records"), F.countDistinct("tag").alias("tags"))


def segment_postings_d3(spark, sf):
    """The inverted index of all records at distance 3, whose segments are as wide as a word."""
    return search.postings(records(spark, sf), 3).withColumn("value", F.lower(F.hex("value")))


def segment_postings(spark, sf):
    """The inverted index of all records at distance 6, values as hex."""
    return search.postings(records(spark, sf), DELTA).withColumn("value", F.lower(F.hex("value")))


def posting_stats(spark, sf):
    """Postings, distinct values and longest list of every type and segment."""
    p = search.postings(records(spark, sf), DELTA)
    return p.groupBy("type", "segment", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("type", "segment").agg(F.sum("n").alias("postings"), F.count(F.lit(1)).alias("distinct_values"), F.max("n").alias("longest_list"))


def postings_integrity(spark, sf):
    """Postings of the stored index that the records don't give, and the reverse, by type."""
    stored = table(spark, sf, "postings").select(norm_name("type").alias("type"), "segment", "value", "record_id").distinct()
    made = search.postings(records(spark, sf), DELTA)
    keys = ["type", "segment", "value", "record_id"]
    both = stored.withColumn("s", F.lit(1)).unionByName(made.withColumn("s", F.lit(2))).groupBy(*keys).agg(F.sum("s").alias("s"))
    return both.groupBy("type").agg(F.count_if(F.col("s") == 1).alias("only_stored"), F.count_if(F.col("s") == 2).alias("only_made"), F.count_if(F.col("s") == 3).alias("both"))


def radius_scan(spark, sf):
    return search.radius_scan(records(spark, sf), arriving(spark, sf), f"default={DELTA}")


def radius_exact(spark, sf):
    return search.radius_exact(records(spark, sf), arriving(spark, sf), f"default={DELTA}")


def radius_candidates(spark, sf):
    """Matching records of every arriving record: how many, the smallest distance and the best by (distance, tag)."""
    hits = radius_exact(spark, sf)
    best = hits.groupBy("type", "query_tag").agg(F.sum("n").alias("candidates"), F.min(F.struct("distance", "tag")).alias("b"))
    q = arriving(spark, sf).withColumnRenamed("tag", "query_tag")
    return q.join(best, ["type", "query_tag"]).select("query_id", "candidates", F.col("b.distance").alias("distance"), F.col("b.tag").alias("tag"))


def typed_thresholds(spark, sf):
    """Radius search with a distance of each type's own."""
    return search.radius_exact(records(spark, sf), arriving(spark, sf), SPEC)


def boundary_flips(spark, sf):
    """Per number k from 0 to 8 of inverted leading bits, the tags whose flipped form finds them by radius search at distances 4, 5 and 6."""
    tags = materialise(search.distinct_of(records(spark, sf)).select("type", "tag"))
    mask = [f"{((1 << k) - 1) << (8 * 8 - k):016x}" if k else "0" * 16 for k in range(9)]
    flips = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("mask")) for k, m in enumerate(mask)])
    head = F.conv(F.substring("tag", 1, 16), 16, -10).cast("bigint").bitwiseXOR(F.conv(F.col("f.mask"), 16, -10).cast("bigint"))
    asked = tags.withColumn("f", F.explode(flips)).select("type", F.col("f.k").alias("k"), F.col("tag").alias("base"), F.concat(F.lower(F.lpad(F.hex(head), 16, "0")), F.substring("tag", 17, 48)).alias("tag"))
    asked = materialise(asked)
    out = asked.groupBy("k").agg(F.count(F.lit(1)).alias("tags"))
    for t in (4, 5, 6):
        hits = search.radius_exact(tags, asked, f"default={t}").select("type", F.col("query_tag").alias("tag"), F.col("tag").alias("base"))
        found = asked.join(hits, ["type", "tag", "base"], "left_semi").groupBy("k").agg(F.count(F.lit(1)).alias(f"found_{t}"))
        out = out.join(found, "k", "left")
    return out.fillna(0)


def strategy_equivalence(spark, sf):
    """Rows of scan, index search and filtered index search, and rows that not all of them have."""
    cols = ["type", "query_tag", "tag", "distance", "n"]
    ways = [radius_scan(spark, sf), radius_exact(spark, sf), radius_prefuzz(spark, sf)]
    both = None
    for i, w in enumerate(ways):
        one = w.select(*cols, F.lit(1 << i).alias("s"))
        both = one if both is None else both.unionByName(one)
    s = F.col("s")
    return both.groupBy(*cols).agg(F.sum("s").alias("s")).agg(*[F.count_if(s.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0).alias(f"{n}_rows") for i, n in enumerate(("scan", "exact", "prefuzz"))], F.count_if(s != 7).alias("different"))


def radius_counters(spark, sf):
    """Work of the three strategies for every arriving record."""
    return search.radius_counters(materialise(records(spark, sf)), materialise(arriving(spark, sf)), DELTA)


def radius_counters_d1(spark, sf):
    """Work of the three strategies at distance 1."""
    return search.radius_counters(materialise(records(spark, sf)), materialise(arriving(spark, sf)), 1)


def radius_prefuzz(spark, sf):
    """The rows of the radius search by the segments that the membership filter passes."""
    return search.radius_prefuzz(records(spark, sf), arriving(spark, sf), DELTA)


def candidate_records(spark, sf):
    """The candidates of every arriving record by record, in the order in which they are tried."""
    return search.candidates(materialise(records(spark, sf)), materialise(arriving(spark, sf)), f"default={DELTA}")


def global_min(spark, sf):
    return search.global_min(records(spark, sf), arriving(spark, sf), DELTA)


def first_match(spark, sf):
    return search.first_match(records(spark, sf), arriving(spark, sf), DELTA)


def cross_scheme_agreement(spark, sf):
    """Arriving records by whether the three searches, types ignored, match; a row with differing flags is a fault."""
    r, q = materialise(records(spark, sf)), materialise(arriving(spark, sf))
    hit = search.radius_exact(untyped(r), untyped(q), f"default={DELTA}").select(F.col("query_tag").alias("tag")).distinct().withColumn("radius", F.lit(1))
    a = q.filter("tag is not null").join(hit, "tag", "left").select("query_id", F.coalesce("radius", F.lit(0)).alias("radius"))
    b = search.global_min(r, q, DELTA).select("query_id", F.col("matched").alias("minimum"))
    c = search.first_match(r, q, DELTA).select("query_id", F.col("matched").alias("first"))
    return a.join(b, "query_id", "full_outer").join(c, "query_id", "full_outer").groupBy("radius", "minimum", "first").agg(F.count(F.lit(1)).alias("queries"))


def _filter_inputs(spark, sf):
    r = records(spark, sf)
    values = search.postings(r, DELTA).select("type", "segment", "value").distinct()
    return values, r.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def filter_membership(spark, sf):
    """Per type and segment, the arriving values that the membership filter passes and those that are really stored."""
    values, capacity = _filter_inputs(spark, sf)
    entries = filters.filter_entries(values, capacity, 0.01)
    asked = search.postings(arriving(spark, sf).withColumn("record_id", F.lit(0)).filter("tag is not null"), DELTA).select("type", "segment", "value").distinct()
    marked = filters.with_fingerprint(asked, capacity, 0.01).join(entries.select("type", "segment", "bin", "mini", F.lit(1).alias("p")), ["type", "segment", "bin", "mini"], "left").join(values.withColumn("s", F.lit(1)), ["type", "segment", "value"], "left")
    return marked.groupBy("type", "segment").agg(F.count(F.lit(1)).alias("asked"), F.coalesce(F.sum("p"), F.lit(0)).alias("passed"), F.coalesce(F.sum("s"), F.lit(0)).alias("stored"))


def filter_bytes(spark, sf):
    """Bytes of each type's filters at distance 6."""
    values, capacity = _filter_inputs(spark, sf)
    return filters.filter_bytes(filters.filter_entries(values, capacity, 0.01), capacity, DELTA + 1)


def exact_duplicates(spark, sf):
    """Distinct bodies, further copies and groups of copies."""
    return stats.duplicate_counts(manifest_once(spark, sf), "digest")


def duplicate_distribution(spark, sf):
    return stats.duplicate_distribution(manifest_once(spark, sf), "digest")


def duplicate_buckets_by_role(spark, sf):
    """Records of each role by the size of their body's group."""
    m = manifest_once(spark, sf).filter("digest is not null")
    n = m.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    per = m.groupBy("role", "digest").agg(F.count(F.lit(1)).alias("k")).join(n, "digest")
    return per.groupBy("role", stats.duplicate_bucket(F.col("n")).alias("bucket")).agg(F.sum("k").alias("records"))


def _pool(spark, sf):
    m = manifest_once(spark, sf)
    return experiment.exact_ref(m.filter("role = 'query_pool'"), m.filter("role = 'reference'"), "digest")


def exact_ref_labels(spark, sf):
    """Every record of the query pool with whether a reference record has its body."""
    return _pool(spark, sf).select("id", "group")


def reference_split(spark, sf):
    """Records of a new split in hash order by part, with the digests that both parts have."""
    pool, rest = experiment.split(manifest_once(spark, sf), "id", POOL, SEED)
    rows = pool.withColumn("part", F.lit("pool")).unionByName(rest.withColumn("part", F.lit("reference")))
    return rows.select("id", "part")


def largest_remainder(spark, sf):
    """Seats of the groups of the query pool."""
    return experiment.largest_remainder(_pool(spark, sf).groupBy("group").agg(F.count(F.lit(1)).alias("n")), BENCHMARK)


def stratified_sample(spark, sf):
    """A benchmark sample in proportion to the groups, and one verification record of each."""
    bench, check = experiment.stratified(_pool(spark, sf), "id", BENCHMARK, SEED)
    return bench.select(F.lit("benchmark").alias("part"), "id", "group").unionByName(check.select(F.lit("verify").alias("part"), "id", "group"))


def summary_grouping_sets(spark, sf):
    m = measured(spark, sf).filter("latency_us is not null")
    return stats.summarise(m, "strategy", "run_id", "type", "query_id", "latency_us", F.col("candidate_count") > 0, COUNTERS)


def percentile_variants(spark, sf):
    """Percentiles of latency by strategy in the definitions that are in use side by side."""
    n = F.col("n")
    at = {"p95_ceil": stats.ceil_index(n, "0.95"), "p95_round": stats.half_even_index(n, 0.95), "p50_ceil": stats.ceil_index(n, "0.5"), "low": F.floor((n - 1) / 2), "high": F.floor(n / 2)}
    out = stats.order_statistics(measured(spark, sf), ["strategy"], "latency_us", at)
    return out.select("strategy", "n", "p95_ceil", "p95_round", "p50_ceil", ((F.col("low") + F.col("high")) / 2).alias("median"))


def tail_summary(spark, sf):
    m = measured(spark, sf)
    a = stats.tail_summary(m, ["strategy", "type"], "candidate_count")
    return a.unionByName(stats.tail_summary(m, ["strategy", "type"], "full_tag_distance_computations"))


def query_analysis(spark, sf):
    """Mean and largest number of candidates of every query and strategy."""
    return measured(spark, sf).groupBy("query_id", "strategy").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("candidate_count"), 6).alias("mean_candidates"), F.max("candidate_count").alias("max_candidates"))


def _run_summary(m: DataFrame) -> DataFrame:
    return m.groupBy("strategy", "type").agg(F.avg("latency_us").alias("mean_latency"), F.avg((F.col("candidate_count") > 0).cast("int")).alias("matched_rate"))


def scale_comparison(spark, sf):
    """Later against earlier runs by strategy and type, cut behind the middle run."""
    m = measured(spark, sf)
    runs = m.select("run_id").distinct()
    middle = runs.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY run_id)").alias("x"))
    late = F.col("run_id") > middle.scalar()
    return stats.scale_comparison(_run_summary(m.filter(late)), _run_summary(m.filter(~late)), ["strategy", "type"])


def workload_agreement(spark, sf):
    """How far the index strategies agree on their counters per run, query and repeat."""
    m = measured(spark, sf)
    metrics = ["candidate_count", "posting_records_read", "full_tag_distance_computations"]
    return stats.agreement(m.filter("strategy = 'exact'"), m.filter("strategy = 'prefuzz'"), ["run_id", "type", "query_id", "repeat"], metrics)


def _shingled(spark, sf):
    docs = documents(spark, sf)
    rows = materialise(similarity.shingle_rows(docs, "doc_id", "text"))
    return docs, rows


def shingle_candidates(spark, sf):
    """Candidates by the reference's rule of rare shingles; the four queries that use it report that rule, similar_texts all pairs."""
    return similarity.candidate_pairs(_shingled(spark, sf)[1])


def _repeated(docs) -> bool:
    """Whether a doc_id has several rows: its runs then count once for all of them, which sets of texts don't have."""
    return not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def _classed(spark, sf, similar=False):
    """Classed candidate pairs, to be read once, and the digests of all documents. similar: pairs of class possible_similar suffice."""
    docs = documents(spark, sf)
    if not _repeated(table(spark, sf, "documents").filter("text is not null")):
        sets = text_sets.text_sets(docs, "doc_id", "text")
        return text_sets.classed_pairs(sets, similar), sets.digests
    rows = materialise(similarity.shingle_rows(docs, "doc_id", "text"))
    digests = materialise(docs.select(F.col("doc_id").alias("doc"), F.sha2("text", 256).alias("digest")))
    return materialise(similarity.classify(similarity.jaccard(similarity.candidate_pairs(rows), rows), digests)), digests


def jaccard_classes(spark, sf):
    """Candidate pairs with their similarity and class."""
    return _classed(spark, sf)[0].withColumn("jaccard", F.round("jaccard", 9))


def similarity_statistics(spark, sf):
    """Pairs and mean similarity by class."""
    return _classed(spark, sf)[0].groupBy("class").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("jaccard"), 6).alias("mean_jaccard"))


def doc_classes(spark, sf):
    """Documents by class."""
    return similarity.document_classes(*_classed(spark, sf, similar=True)).groupBy("class").agg(F.count(F.lit(1)).alias("documents"))


def _similar_texts(spark, sf):
    """Pairs of distinct texts by the smallest documents that have them, with the texts' copies, to be read once, and all digests."""
    docs = documents(spark, sf)
    if not _repeated(table(spark, sf, "documents").filter("text is not null")):
        sets = text_sets.text_sets(docs, "doc_id", "text")
        return text_sets.similar_texts(sets), sets.digests
    once, digests = similarity.distinct_texts(docs, "doc_id", "text")
    once, digests = materialise(once), materialise(digests)
    runs = similarity.shingle_rows(once, "doc", "text").select("doc", F.xxhash64("h").alias("h"))
    pairs = materialise(similarity.similar_pairs(materialise(runs)))
    copies = lambda c: once.select(F.col("doc").alias(c), F.col("copies").alias(f"copies_{c}"))
    return pairs.join(copies("a"), "a").join(copies("b"), "b"), digests


def similar_texts(spark, sf):
    """All pairs of different texts with a similarity of 0.5 or more, by their smallest documents, with the copies of either."""
    return _similar_texts(spark, sf)[0].select("a", "b", "copies_a", "copies_b", "shared", F.round("jaccard", 9).alias("jaccard"))


def similar_doc_classes(spark, sf):
    """Documents by class, as doc_classes, but by all similar pairs: a text of several documents is an exact body anyway."""
    pairs, digests = _similar_texts(spark, sf)
    classed = pairs.withColumn("class", F.lit("possible_similar"))
    return similarity.document_classes(classed, digests).groupBy("class").agg(F.count(F.lit(1)).alias("documents"))


def _uploads(spark, sf):
    d = documents(spark, sf)
    return materialise(d.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("pos"), F.lit("text").alias("type"), text_tag("text").alias("tag"), text_tag("text", RECOVERY_DOMAIN).alias("recovery"), "mailbox"))


def greedy_dedup(spark, sf):
    """Which document is stored and which reuses which, in order of doc_id."""
    return greedy.assign(_uploads(spark, sf).drop("mailbox"))


def user_refs(spark, sf):
    """Representatives that each mailbox refers to, once."""
    u = _uploads(spark, sf)
    at = greedy.assign(u.drop("mailbox")).join(u.select("id", "pos", "mailbox"), "id")
    return protocol.references(at.select(F.col("mailbox").alias("uid"), "rid", F.col("pos").alias("created")))


def upload_counts(spark, sf):
    """Processed, stored and reused uploads."""
    return greedy_dedup(spark, sf).agg(F.count(F.lit(1)).alias("processed"), F.count_if("stored").alias("stored"), F.count_if(~F.col("stored")).alias("reused"))


def policy_containment(spark, sf):
    """Per mailbox, whether its languages contain those of a policy."""
    langs = documents(spark, sf).filter("mailbox is not null and lang is not null").groupBy("mailbox").agg(F.collect_set(norm_name("lang")).alias("langs"))  # a handful of names
    return langs.select("mailbox", protocol.contains_all(F.array(F.lit("en"), F.lit("de")), F.col("langs")).cast("int").alias("allowed"))


def threshold_lookup(spark, sf):
    """The distance allowed for each type of record."""
    parse_thresholds(SPEC)
    return records(spark, sf).select("type").distinct().select("type", threshold_for("type", SPEC).alias("delta"))


def manifest_integrity(spark, sf):
    """Faults of manifest and tags: ids without the other side, unreadable digests and tags, repeated ids."""
    m = table(spark, sf, "manifest").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(hex256("body_sha256")).alias("digest"), F.max(norm_name("split_role")).alias("role"))
    t = table(spark, sf, "tags").groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.max(hex256("tag_hex")).alias("tag"))
    both = m.join(t, "id", "full_outer")
    ref = F.col("role") == "reference"
    return both.agg(F.count_if(F.col("n") > 1).alias("repeated_records"), F.count_if(F.col("n").isNotNull() & F.col("digest").isNull()).alias("unreadable_digests"), F.count_if(ref & F.col("k").isNull()).alias("references_without_tag"), F.count_if(F.col("k").isNotNull() & F.col("n").isNull()).alias("tags_without_record"), F.count_if(F.col("k").isNotNull() & F.col("tag").isNull()).alias("unreadable_tags"))


def split_integrity(spark, sf):
    """Splits whose reported counts differ from the manifest's, the groups of the query pool among them (null counts as 0)."""
    cols = ["total_records", "reference_count", "query_pool_count"]
    groups = [F.coalesce(F.max(f"query_pool_groups.{g}"), F.lit(0)).alias(f"reported_{g}") for g in ("exact_ref", "no_exact_ref")]
    s = table(spark, sf, "split_summary").groupBy("split_id").agg(*[F.max(c).alias(c) for c in cols], *groups)
    m = materialise(manifest_once(spark, sf))
    n = m.groupBy("split_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("role") == "reference").alias("ref"), F.count_if(F.col("role") == "query_pool").alias("pool"))
    pool = experiment.exact_ref(m.filter("role = 'query_pool' and digest is not null"), m.filter("role = 'reference'"), "digest")
    k = pool.groupBy("split_id").agg(*[F.count_if(F.col("group") == g).alias(g) for g in ("exact_ref", "no_exact_ref")])
    at = s.join(n, "split_id", "full_outer").join(k, "split_id", "left").fillna(0, ["exact_ref", "no_exact_ref"])
    pairs = [("total_records", "total"), ("reference_count", "ref"), ("query_pool_count", "pool"), ("reported_exact_ref", "exact_ref"), ("reported_no_exact_ref", "no_exact_ref")]
    wrong = F.lit(False)
    for x, y in pairs:
        wrong = wrong | ~F.col(x).eqNullSafe(F.col(y))
    return at.filter(wrong).select("split_id", *[c for p in pairs for c in p])


def metadata_lines(spark, sf):
    """Counts read back from lines of name=value pairs."""
    s = table(spark, sf, "split_summary").groupBy("split_id").agg(F.max("total_records").alias("total_records"), F.max("reference_count").alias("reference_count"))
    line = F.concat(F.lit("records="), F.col("total_records"), F.lit(", reference="), F.col("reference_count"), F.lit(", split="), F.col("split_id"))
    m = s.select(metadata_line(line).alias("m"))
    return m.select(F.col("m")["split"].cast("bigint").alias("split_id"), F.col("m")["records"].cast("bigint").alias("records"), F.col("m")["reference"].cast("bigint").alias("reference"))


def index_signature(spark, sf):
    """Signature of the index over all records."""
    text = signature(records(spark, sf), "default=6")
    return spark.createDataFrame([(text,)], "signature string")


def metadata_types(spark, sf):
    """Values of a line of name=value pairs as whole number, real number and text."""
    m = measured(spark, sf).filter("latency_us is not null").groupBy("strategy", "run_id").agg(F.count(F.lit(1)).alias("n"))
    line = F.concat(F.lit("strategy="), "strategy", F.lit(", n="), "n", F.lit(", half="), F.format_string("%.1f", F.col("n") / 2), F.lit(", run="), "run_id")
    t = m.select(metadata_line(line).alias("m")).select(F.transform_values("m", lambda k, v: typed_value(v)).alias("t"))
    return t.select(F.col("t")["run"]["whole"].alias("run_id"), F.col("t")["strategy"]["text"].alias("strategy"), F.col("t")["n"]["whole"].alias("n"), F.col("t")["half"]["real"].alias("half"))


def strategy_summary(spark, sf):
    """Means, 95th percentile and sums of every strategy and of all."""
    return stats.strategy_summary(measured(spark, sf), "strategy", "latency_us", COUNTERS)


def run_comparison(spark, sf):
    """Filtered and unfiltered index search side by side for every measurement that both have."""
    m = materialise(measured(spark, sf))
    return stats.run_comparison(m.filter("strategy = 'prefuzz'"), m.filter("strategy = 'exact'"), ["run_id", "type", "query_id", "repeat"], "latency_us", COUNTERS)


def latency_comparison(spark, sf):
    """Latencies of filtered and unfiltered index search by run."""
    m = materialise(measured(spark, sf))
    return stats.latency_comparison(m.filter("strategy = 'prefuzz'"), m.filter("strategy = 'exact'"), ["run_id"], "latency_us")


def threshold_order(spark, sf):
    """The order in which a query takes the three thresholds, by its place among the arriving records."""
    q = with_positions(arriving(spark, sf).select("query_id"), ["query_id"], "place")
    turn = q.withColumn("offset", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return turn.select("query_id", "offset", F.element_at(F.array(F.lit(4), F.lit(5), F.lit(6)), (stats.rotation(F.col("place"), F.lit(1), F.col("offset"), 3) + 1).cast("int")).alias("threshold"))


def similarity_report(spark, sf):
    """Short documents, pairs of equal texts and document classes by source and for all."""
    classed, digests = _classed(spark, sf)
    docs = documents(spark, sf).withColumn("source", norm_name("source"))
    return similarity.similarity_report(docs, "doc_id", "text", "source", materialise(similarity.document_classes(classed, digests)))


def random_pairs(spark, sf):
    """Random pairs of documents with their similarity."""
    docs, rows = _shingled(spark, sf)
    pairs = materialise(similarity.random_pairs(docs.select("doc_id"), "doc_id", PAIRS, SEED))
    return similarity.jaccard(pairs, rows).join(pairs, ["a", "b"]).select("draw", "a", "b", "shared", F.round("jaccard", 9).alias("jaccard"))


def bloom_bits(spark, sf):
    """Per type, the postings' distinct values and the bits that they set in a Bloom filter."""
    values = search.postings(records(spark, sf), DELTA).select("type", "segment", "value").distinct()
    bits = values.select("type", F.explode(filters.bloom_positions(F.col("value"), 7, 1 << 20)).alias("bit"))
    n = values.groupBy("type").agg(F.count(F.lit(1)).alias("values"))
    return bits.distinct().groupBy("type").agg(F.count(F.lit(1)).alias("bits")).join(n, "type")


def early_exit_distances(spark, sf):
    """Distances of matching tags, counted byte by byte until they exceed 3."""
    hits = radius_exact(spark, sf).select("type", "query_tag", "tag")
    return hits.withColumn("distance", distance_until("tag", "query_tag", 3))


def video_tags(spark, sf):
    """Tags of videos of 100 record numbers each, by majority over the tags of their frames."""
    frames = records(spark, sf).filter("type = 'video'").select(F.floor(F.col("record_id") / 100).alias("video"), F.col("record_id").alias("frame"), "tag")
    return media.video_tags(frames)


def weight_blocks(spark, sf):
    """Records of the weight-partitioned store by block, read back from it."""
    path = shared_dir(spark)
    return WeightBlocks(spark, path).build(records(spark, sf)).blocks()


def secret_shares(spark, sf):
    """Per mailbox, the shares of a secret under the policy of its languages, and whether a user with English and German gets it back."""
    langs = documents(spark, sf).filter("mailbox is not null and lang is not null").groupBy("mailbox").agg(F.collect_set(norm_name("lang")).alias("langs"))  # a handful of names
    secret = F.length("mailbox").cast("bigint") * F.lit(1000003)
    at = langs.select("mailbox", secret.alias("secret"), protocol.share_secret(secret, F.col("langs"), "seed").alias("s"))
    got = at.withColumn("got", protocol.join_shares(F.col("s"), F.array(F.lit("en"), F.lit("de"))))
    return got.select("mailbox", F.size("s").alias("shares"), F.coalesce(F.col("got") == F.col("secret"), F.lit(False)).alias("recovered"))


def oblivious_transfer(spark, sf):
    """Per mailbox, which of two messages comes out of an oblivious transfer, and the bytes sent."""
    m = documents(spark, sf).filter("mailbox is not null").groupBy("mailbox").agg((F.count(F.lit(1)) % 2).cast("int").alias("choice"))
    rows = m.select(F.col("mailbox").alias("ident"), F.concat(F.lit("first "), "mailbox").cast("binary").alias("first"), F.concat(F.lit("second "), "mailbox").cast("binary").alias("second"), "choice")
    got = protocol.transfer(widen(rows), "seed")
    return got.select(F.col("ident").alias("mailbox"), F.col("received").cast("string").alias("received"), "sent")


def stream_equals_batch(spark, sf):
    """Decisions on all documents taken in 1, 3 and 10 batches: how many, and how many differ from those of one table."""
    d = documents(spark, sf).select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("pos"), F.lit("text").alias("type"), F.col("text").alias("content"))
    d = materialise(d)
    want = materialise(greedy.assign(_uploads(spark, sf).drop("mailbox")))
    low, high = d.agg(F.min("pos"), F.max("pos")).first()
    out = None
    for cuts in (1, 3, 10):
        path = shared_dir(spark)
        store = UploadStore(spark, path)
        for k in range(cuts):
            part = F.floor((F.col("pos") - F.lit(low or 0)) * cuts / F.lit((high or 0) - (low or 0) + 1))
            store.add(d.filter(part == k), k)
        got = store.decisions().select("id", "rid", "distance", "stored")
        one = got.withColumn("s", F.lit(1)).unionByName(want.withColumn("s", F.lit(2))).groupBy("id", "rid", "distance", "stored").agg(F.sum("s").alias("s"))
        one = one.agg(F.lit(cuts).cast("bigint").alias("batches"), F.count_if(F.col("s") != 2).alias("decisions"), F.count_if(F.col("s") != 3).alias("different"))
        out = one if out is None else out.unionByName(one)
    return out


def fuzzy_recovery(spark, sf):
    """Whether a key is recovered from a document's representation with k flipped bits, by k from 0 to 8."""
    rows = documents(spark, sf).select("doc_id", "text", F.pmod("doc_id", F.lit(9)).alias("flips"))

    @F.pandas_udf(T.BooleanType())
    def recovered(texts, flips):
        import pandas as pd

        out = []
        for t, k in zip(texts, flips, strict=True):
            x = simhash(t.encode("utf-8", "surrogatepass"), RECOVERY_DOMAIN)
            key, helper = crypto.extract_new(x, crypto.pad_stream(x, 90))
            b = crypto.bits_of(x).copy()
            b[[(37 * i) % 255 for i in range(int(k))]] ^= 1
            out.append(crypto.extract_again(crypto.bytes_of(b), helper) == key)
        return pd.Series(out)

    return rows.withColumn("ok", recovered("text", "flips")).groupBy("flips").agg(F.count(F.lit(1)).alias("documents"), F.count_if("ok").alias("recovered"))


def ownership_round_trip(spark, sf):
    """Documents stored encrypted, claimed by their owner and by somebody with another document: proven and recovered claims."""
    docs = documents(spark, sf).select(F.col("doc_id").cast("string").alias("rid"), F.lit("text").alias("type"), F.col("text").cast("binary").alias("content"))
    stored = protocol.first_upload(docs, "seed", keep=True).withColumnRenamed("content", "own")  # no join brings the document back
    false_claim = F.concat(F.lit("another document altogether ").cast("binary"), F.unhex(F.sha2("rid", 256)))
    claims = stored.withColumn("c", F.explode(F.array(F.struct(F.lit("owner").alias("who"), F.col("own").alias("content")), F.struct(F.lit("other").alias("who"), false_claim.alias("content")))))
    claims = claims.select("*", "c.who", "c.content", F.lit("u").alias("uid"), F.unhex(F.sha2(F.concat("rid", "c.who"), 256)).alias("token")).drop("c")
    got = protocol.recover(protocol.prove(claims))
    return got.groupBy("who").agg(F.count(F.lit(1)).alias("claims"), F.count_if("proven").alias("proven"), F.count_if(F.col("file") == F.col("own")).alias("recovered"))


def challenge_answers(spark, sf):
    """Answers to one-time challenges by outcome: each event row issues one, answered in time, late, twice or by another user."""
    e = table(spark, sf, "events").select("event_id", "user_id")
    token = F.col("event_id").cast("string")
    uid = F.col("user_id").cast("string")
    kind = F.pmod("event_id", F.lit(5))
    issue = e.select(token.alias("token"), F.lit("issue").alias("kind"), uid.alias("uid"), F.lit(0).cast("bigint").alias("at"), F.lit(True).alias("valid"))
    answer = e.select(token.alias("token"), F.lit("answer").alias("kind"), F.when(kind == 3, F.lit("x")).otherwise(uid).alias("uid"), F.when(kind == 1, 121).otherwise(120).cast("bigint").alias("at"), (kind != 4).alias("valid"))
    again = e.filter(kind == 2).select(token.alias("token"), F.lit("answer").alias("kind"), uid.alias("uid"), F.lit(130).cast("bigint").alias("at"), F.lit(True).alias("valid"))
    return answer_challenges(issue.unionByName(answer).unionByName(again)).groupBy("accepted", "reason").agg(F.count(F.lit(1)).alias("answers"))


def sampled_proof(spark, sf):
    """Mean estimate of the distance of linked tags from 64 sampled bits, and claims accepted at 6, by true distance."""
    hits = radius_exact(spark, sf).select("query_tag", "tag", "distance")
    made = protocol.sampled_proof(hits.select(F.col("tag").alias("stored"), F.col("query_tag").alias("claim"), "distance"), 64, 7, 6)
    return made.groupBy("distance").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("estimate"), 6).alias("mean_estimate"), F.count_if("accepted").alias("accepted"))


def aead_round_trip(spark, sf):
    """Documents that come back from authenticated encryption with the right and with wrong associated data."""
    key, iv = F.unhex(F.sha2(F.concat(F.lit("k"), "doc_id"), 256)), F.unhex(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 24))
    aad = F.col("doc_id").cast("string").cast("binary")
    sealed = documents(spark, sf).select("doc_id", F.col("text").cast("binary").alias("plain"), key.alias("key"), iv.alias("iv"), aad.alias("aad"))
    sealed = sealed.withColumn("c", F.aes_encrypt("plain", "key", F.lit("GCM"), F.lit("DEFAULT"), "iv", "aad"))
    opened = lambda a: F.try_aes_decrypt("c", "key", F.lit("GCM"), F.lit("DEFAULT"), a)
    return sealed.agg(F.count(F.lit(1)).alias("documents"), F.count_if(opened("aad") == F.col("plain")).alias("opened"), F.count_if(opened(F.lit(b"other")).isNotNull()).alias("opened_wrongly"))


def image_tags(spark, sf):
    """Perceptual tags of the vectors taken as grey pictures, all their values in rows as near to a square as their number allows."""
    from hamloom.functions.media import as_image, private_representation, public_tag

    @F.pandas_udf("struct<tag: string, representation: string>")
    def tag(vectors):
        import pandas as pd

        pictures = [as_image(v) for v in vectors]
        return pd.DataFrame([(public_tag(x).hex(), private_representation(x).hex()) for x in pictures], columns=["tag", "representation"])

    return widen(table(spark, sf, "embeddings")).filter("embedding is not null").select("vec_id", tag("embedding").alias("t")).select("vec_id", "t.*")


NAMES: tuple[Callable[..., DataFrame], ...] = (
    text_tags, recovery_tags, normalized_tags, word_counts, body_extract, corpus_totals, tag_weights, segment_postings, posting_stats, postings_integrity,
    segment_postings_d3, radius_scan, radius_exact, radius_prefuzz, radius_candidates, candidate_records, typed_thresholds, boundary_flips, strategy_equivalence, radius_counters, radius_counters_d1, global_min, first_match,
    cross_scheme_agreement, filter_membership, filter_bytes, exact_duplicates, duplicate_distribution, duplicate_buckets_by_role, exact_ref_labels,
    reference_split, largest_remainder, stratified_sample, summary_grouping_sets, percentile_variants, tail_summary, query_analysis, scale_comparison,
    workload_agreement, shingle_candidates, jaccard_classes, similarity_statistics, doc_classes, similar_texts, similar_doc_classes, greedy_dedup, user_refs, upload_counts, policy_containment,
    similarity_report, random_pairs, strategy_summary, run_comparison, latency_comparison, threshold_order, bloom_bits, early_exit_distances, video_tags,
    weight_blocks, secret_shares, oblivious_transfer, stream_equals_batch, metadata_types, threshold_lookup, manifest_integrity, split_integrity, metadata_lines, index_signature, fuzzy_recovery, ownership_round_trip, challenge_answers,
    sampled_proof, aead_round_trip, image_tags,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of the core; each takes (spark, sf_dir)."""
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in NAMES}
    return out | {"p5_found": heavy_keys.p5_found, "p5_shares": heavy_keys.p5_shares}
