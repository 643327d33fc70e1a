"""Pairs of texts that share rare word runs, their Jaccard similarity and the classes of pairs and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from hamloom.functions.text import shingles, words
from hamloom.operators.skew import with_positions
from hamloom.session import materialise

#: A shingle is rare if at least 2 and at most MAX_DF documents have it; a document proposes by its RAREST rarest ones.
SIZE, MAX_DF, RAREST = 5, 40, 12


def shingle_rows(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(doc, h): one row per document and distinct run of five words, h being the MD5 of the run."""
    runs = shingles(words(text), SIZE, " ")
    # repeated runs of a document are in one task and combined there, before the shuffle
    return docs.select(F.col(ident).alias("doc"), F.explode(runs).alias("run")).select("doc", F.md5(F.col("run").cast("binary")).alias("h")).distinct()


def candidate_pairs(rows: DataFrame) -> DataFrame:
    """(a, b), a < b: documents of which one has the other in the list of one of its rarest shared shingles.

    This is the reference's rule, which doesn't find all: families of over MAX_DF members give no pair. similar_pairs does.

    Lists hold at most MAX_DF documents, so the join gives at most RAREST x MAX_DF pairs per document.
    """
    df = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df").between(2, MAX_DF))
    usable = rows.join(df, "h")
    rank = F.row_number().over(W.partitionBy("doc").orderBy("df", "h"))
    asks = usable.withColumn("r", rank).filter(F.col("r") <= RAREST).select("h", F.col("doc").alias("x"))
    met = asks.join(usable.select("h", F.col("doc").alias("y")), "h").filter("x <> y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def distinct_texts(docs: DataFrame, ident: str, text: str) -> tuple[DataFrame, DataFrame]:
    """((doc, copies, text), (doc, digest)): every distinct text under its smallest document, and the digests of all documents."""
    digests = docs.select(F.col(ident).alias("doc"), F.col(text).alias("text"), F.sha2(text, 256).alias("digest"))
    once = digests.groupBy("digest").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    return once.select("doc", "copies", "text"), digests.select("doc", "digest")


def similar_pairs(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b, shared, jaccard), a < b: all pairs with a Jaccard similarity of at least `least`, however frequent their shingles.

    Exact prefix filter: with all shingles in one order, rare ones first, the first shingle that two such documents share is
    among the first n - ceil(least x n) + 1 of either's n. The smaller has at least `least` times the larger's number, and
    from the first shared one on there must be enough left in both for the needed overlap. Only prefixes are joined, their
    hottest shingles last in order; the pairs that pass are verified by counting.
    """
    df = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    # a shingle of one document joins nothing but keeps its place, which comes first
    common = rows.join(df.filter("df > 1"), "h")
    sizes = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    kept = common.groupBy("doc").agg(F.count(F.lit(1)).alias("m"))
    place = F.row_number().over(W.partitionBy("doc").orderBy("df", "h"))
    at = common.withColumn("r", place).join(sizes.join(kept, "doc"), "doc").withColumn("p", F.col("n") - F.col("m") + F.col("r"))
    prefix = materialise(at.filter(F.col("p") <= F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)) + 1).select("h", "doc", "n", "p"))
    x, y = prefix.alias("x"), prefix.alias("y")
    near = F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * F.lit(least) - F.lit(1e-9)
    left = F.least(F.col("x.n") - F.col("x.p"), F.col("y.n") - F.col("y.p")) + 1
    enough = left >= (F.col("x.n") + F.col("y.n")) * F.lit(least / (1 + least)) - F.lit(1e-9)
    met = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.doc") < F.col("y.doc")) & near & enough)
    pairs = materialise(met.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct())
    return jaccard(pairs, rows).filter(F.col("jaccard") >= least)


def jaccard(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, shared, jaccard) of pairs (a, b): shared runs over all runs; 0 if either has none.

    Runs are compared as 64-bit hashes, an array per document, which is no larger than its text; a document's array meets its
    pairs by two joins, so what is shuffled is an array per pair and no row per run.
    """
    h = F.col("h") if isinstance(rows.schema["h"].dataType, T.LongType) else F.xxhash64("h")
    sets = materialise(rows.select("doc", h.alias("h")).groupBy("doc").agg(F.collect_list("h").alias("runs")))  # a document's own runs
    pairs = materialise(pairs.select("a", "b"))
    used = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    sets = sets.join(used, "doc", "left_semi")
    left = pairs.join(sets.select(F.col("doc").alias("a"), F.col("runs").alias("x")), "a", "left")
    both = left.join(sets.select(F.col("doc").alias("b"), F.col("runs").alias("y")), "b", "left")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    shared = F.coalesce(F.size(F.array_intersect("x", "y")), F.lit(0)).cast("bigint")
    counted = both.select("a", "b", shared.alias("shared"), F.when(F.col("x").isNull(), 0).otherwise(size("x")).alias("na"), F.when(F.col("y").isNull(), 0).otherwise(size("y")).alias("nb"))
    counted = counted.withColumn("shared", F.greatest("shared", F.lit(0)))
    union = F.col("na") + F.col("nb") - F.col("shared")
    return counted.select("a", "b", "shared", F.coalesce(F.try_divide(F.col("shared"), union), F.lit(0.0)).alias("jaccard"))


def classify(scored: DataFrame, digests: DataFrame) -> DataFrame:
    """scored with `class`: exact_body for equal digests (jaccard then 1), possible_similar from 0.5, low_text_overlap below 0.1,
    else uncertain. digests has (doc, digest)."""
    at = scored.join(digests.select(F.col("doc").alias("a"), F.col("digest").alias("da")), "a").join(digests.select(F.col("doc").alias("b"), F.col("digest").alias("db")), "b")
    same = F.col("da") == F.col("db")
    kind = F.when(same, "exact_body").when(F.col("jaccard") >= 0.5, "possible_similar").when(F.col("jaccard") < 0.1, "low_text_overlap").otherwise("uncertain")
    return at.select("a", "b", "shared", F.when(same, 1.0).otherwise(F.col("jaccard")).alias("jaccard"), kind.alias("class"))


def document_classes(classed: DataFrame, digests: DataFrame) -> DataFrame:
    """(doc, class): exact_body_exists if another document has its digest, else possible_similar if a pair says so, else none."""
    per = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    near = classed.filter("class = 'possible_similar'")
    near = near.select(F.explode(F.array("a", "b")).alias("doc")).distinct().withColumn("_near", F.lit(True))  # pairs are made once
    at = digests.join(per, "digest", "left").join(near, "doc", "left")
    return at.select("doc", F.when(F.col("n") > 1, "exact_body_exists").when(F.col("_near"), "possible_similar").otherwise("none").alias("class"))


def similarity_report(docs: DataFrame, ident: str, text: str, group: str, classes: DataFrame) -> DataFrame:
    """(grp, documents, under_5_words, under_20_words, exact_pairs, exact_body_exists, possible_similar, none) by the group column and,
    as "all", for everything. exact_pairs counts pairs of equal texts, n (n - 1) / 2 for n copies (within the group, or all).
    classes has (doc, class) of every document (document_classes)."""
    n = F.size(words(text))
    rows = docs.select(F.col(ident).alias("doc"), F.col(group).alias("grp"), n.alias("n"), F.unhex(F.sha2(text, 256)).alias("digest")).join(classes, "doc")
    both = rows.select("doc", F.explode(F.array(F.col("grp"), F.lit("all"))).alias("grp"), "n", "digest", "class").filter("grp is not null")
    copies = both.groupBy("grp", "digest").agg(F.count(F.lit(1)).alias("c")).groupBy("grp").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).cast("bigint").alias("exact_pairs"))
    kinds = [F.count_if(F.col("class") == k).alias(k) for k in ("exact_body_exists", "possible_similar", "none")]
    return both.groupBy("grp").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n") < 5).alias("under_5_words"), F.count_if(F.col("n") < 20).alias("under_20_words"), *kinds).join(copies, "grp")


def random_pairs(ids: DataFrame, ident: str, pairs: int, seed: int) -> DataFrame:
    """(draw, a, b), a < b: distinct random pairs of different ids, in order of the draws that gave them first.

    Draw i takes two of the ids' places in sorted order by MD5 over seed, i and a letter; equal places and pairs that came before
    are rejected. At most a quarter of all pairs are given, so that draws don't run on for long. ids are unique.
    """
    spark = ids.sparkSession
    placed = with_positions(ids.select(ident), [ident], "_place")
    n = placed.count()
    want = min(pairs, n * (n - 1) // 4)
    draws = 2 * want + 64
    place = lambda c: F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col("id").cast("string"), F.lit(c)).cast("binary")), 1, 15), 16, 10).cast("bigint"), F.lit(max(n, 1)))
    while True:
        drawn = spark.range(draws).select(F.col("id").alias("draw"), place("a").alias("x"), place("b").alias("y")).filter("x <> y")
        once = drawn.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("draw").alias("draw"))
        once = materialise(once)
        if once.count() >= want:
            break
        draws *= 2
    kept = once.orderBy("draw").limit(want)
    named = lambda c, to: placed.select(F.col("_place").alias(c), F.col(ident).alias(to))
    return kept.join(named("x", "a"), "x").join(named("y", "b"), "y").select("draw", "a", "b")
