"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hamloom.functions.keys import norm_name
from hamloom.llm.tokens import TOKENIZERS, count_tokens
from hamloom.operators.skew import null_safe, spread
from hamloom.session import materialise, table

#: Tokens of a block, the unit that is scheduled and repeated.
BLOCK_TOKENS = 2048
#: Fixed value: the golden ratio's fraction in units of 2^-62, so that slot points are exact whole numbers.
GOLDEN_62 = 2850178471698497291
MASK_62 = (1 << 62) - 1
#: Slots generated by one row of the schedule.
CHUNK = 8192


def sized(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, tokens) of every document; null texts have 0 tokens."""
    rows = documents.select("doc_id", norm_name("source").alias("source"), "text")
    return count_tokens(rows, folder=folder).select("doc_id", "source", "tokens")


def wanted(targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_weight, max_repeats, budget_ratio): one row per mix and source in any spelling."""
    rows = targets.select("mix_id", norm_name("source").alias("source"), "target_weight", "max_repeats", "budget_ratio")
    return rows.groupBy("mix_id", "source").agg(*[F.max(c).alias(c) for c in ("target_weight", "max_repeats", "budget_ratio")])


def blocks(sizes: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 7) -> DataFrame:
    """(source, block, doc_id, first, tokens): the documents of a source in random order, cut into blocks of equal tokens.

    A document that crosses the end of a block goes on in the next: `first` is its first token there. Only the last block
    of a source may be shorter. Places come from hash ranges (operators.skew.spread), so a source may be of any size.
    """
    rows = sizes.filter("tokens > 0").withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    at = spread(rows, ["source"], ["_h", "doc_id"], 64, F.col("tokens"), "start")
    size = F.lit(block_tokens)
    span = F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("tokens") - 1) / size))
    cut = at.withColumn("block", F.explode(span))
    lo = F.greatest(F.col("block") * size, F.col("start"))
    hi = F.least((F.col("block") + 1) * size, F.col("start") + F.col("tokens"))
    return cut.select("source", "block", "doc_id", (lo - F.col("start")).alias("first"), (hi - lo).alias("tokens"))


def slot_point(slot: Column) -> Column:
    """slot * GOLDEN_62 mod 2^62: both factors are cut into halves of 31 bits, so no product of halves overflows."""
    half = 1 << 31
    high, low = GOLDEN_62 >> 31, GOLDEN_62 & (half - 1)
    s1, s0 = F.pmod(F.shiftright(slot, 31), F.lit(half)), F.pmod(slot, F.lit(half))
    upper = F.pmod(F.pmod(s0 * F.lit(high), F.lit(half)) + F.pmod(s1 * F.lit(low), F.lit(half)), F.lit(half))
    return (upper * F.lit(half) + s0 * F.lit(low)).bitwiseAND(F.lit(MASK_62))


def schedule(plan: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(mix_id, slot, source, turn): which source fills each slot, and how often it had a turn before.

    plan has (mix_id, source, target_weight, budget). A mix has ceil(budget / block_tokens) slots; slot i's point is the
    fraction of i times the golden ratio, and the source whose range of cumulative weights holds the point fills it: so
    every stretch of the schedule has nearly the target shares. Slots are made by chunks in many tasks; a slot's turn is
    the number of its source's slots in chunks before, which is a sum over a table of chunks, and in its own chunk.
    """
    by = W.partitionBy("mix_id").orderBy("source")
    total = F.sum("target_weight").over(W.partitionBy("mix_id"))
    cum = plan.filter("target_weight > 0").withColumn("hi", F.sum("target_weight").over(by.rowsBetween(W.unboundedPreceding, 0)) / total)
    last = F.row_number().over(W.partitionBy("mix_id").orderBy(F.col("source").desc())) == 1
    cum = cum.withColumn("hi", F.when(last, F.lit(2.0)).otherwise(F.col("hi")))
    # the sources of a mix are rows of a table of targets: a short list
    mixes = cum.groupBy("mix_id").agg(F.max("budget").alias("budget"), F.array_sort(F.collect_list(F.struct("hi", "source"))).alias("ranges"))
    mixes = mixes.withColumn("slots", F.ceil(F.col("budget") / F.lit(block_tokens)))
    chunks = mixes.filter("slots > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("slots") - 1) / F.lit(CHUNK)))))
    chunks = chunks.repartition(F.col("mix_id"), F.col("chunk"))
    end = F.least(F.col("slots"), (F.col("chunk") + 1) * F.lit(CHUNK)) - 1
    slots = chunks.withColumn("slot", F.explode(F.sequence(F.col("chunk") * F.lit(CHUNK), end)))
    point = slot_point(F.col("slot")) / F.lit(float(1 << 62))
    chosen = F.element_at(F.filter("ranges", lambda r: r["hi"] > point), 1)["source"]
    rows = slots.select("mix_id", "chunk", "slot", chosen.alias("source"))
    sums = rows.groupBy("mix_id", "source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("mix_id", "source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = F.row_number().over(W.partitionBy("mix_id", "source", "chunk").orderBy("slot")) - 1
    mine = rows.withColumn("_in", inner)
    keys = ["mix_id", "source", "chunk"]
    return mine.alias("l").join(before.alias("r"), null_safe(mine, before, keys, "l", "r")).select("l.mix_id", "l.slot", "l.source", (F.col("l._in") + F.col("r.before")).alias("turn"))


#: Slots by which a source's turns may differ from its exact share of a schedule of 2^62 slots or fewer: the golden
#: ratio's points lie within 3 + ln(n) / ln(phi) of any share of n slots.
DISCREPANCY = 93


def mix(sizes: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(slots, report) of the mixes in targets over documents of given sizes.

    slots: (mix_id, slot, source, block, repeat, tokens): the blocks of blocks() in the order to read them; a source's
    blocks are taken in turn, each pass over them being one repeat, at most max_repeats. Turns beyond that stay empty
    and have no row. report: (mix_id, source, size, target_weight, target_tokens, turns, tokens, share, repeats, failed), one row
    per target; turns are the slots that the schedule asked of the source. failed is true if max_repeats x size is less than
    target_weight x budget_ratio x the size of all documents: such a source uses up all its repeats in the schedule but for
    DISCREPANCY turns and the filling of its last block, and of those that do, the tokens are compared exactly.
    Null weights and repeats count as 0; sources without documents have size 0; documents of sources that aren't asked for
    count in the size of all only. An empty table of targets gives no rows.
    """
    plan, total = _plan(sizes, targets)
    turns = schedule(plan.withColumn("budget", F.col("budget_ratio") * F.lit(total)), block_tokens)
    n = F.ceil(F.col("r.size") / F.lit(block_tokens))
    known = turns.alias("l").join(F.broadcast(plan).alias("r"), null_safe(turns, plan, ["mix_id", "source"], "l", "r"))  # plan has the rows of targets
    fits = (n > 0) & (F.col("l.turn") < n * F.coalesce("r.max_repeats", F.lit(0)))
    block, repeat = F.pmod(F.col("l.turn"), n), F.floor(F.col("l.turn") / n)
    # each repeat starts elsewhere
    block = F.pmod(block + repeat * F.lit(7919), n)
    # an empty turn has no block, repeat and tokens
    placed = known.select("l.mix_id", "l.slot", "l.source", F.when(fits, block).alias("block"), F.when(fits, repeat).alias("repeat"), F.when(fits, F.least(F.lit(block_tokens).cast("bigint"), F.col("r.size") - block * F.lit(block_tokens))).alias("tokens"))
    got = placed.groupBy("mix_id", "source").agg(F.count(F.lit(1)).alias("turns"), F.sum("tokens").alias("tokens"), (F.max("repeat") + 1).alias("repeats"))
    kept = [F.coalesce(f"r.{c}", F.lit(0)).alias(c) for c in ("turns", "tokens", "repeats")]
    both = plan.alias("l").join(got.alias("r"), null_safe(plan, got, ["mix_id", "source"], "l", "r"), "left").select("l.*", *kept)
    mine = W.partitionBy("mix_id")
    full = F.col("max_repeats") * (F.ceil(F.col("size") / F.lit(block_tokens)) - 1)
    ran_out = (F.col("turns") + F.lit(DISCREPANCY)) * F.greatest(F.sum("target_weight").over(mine), F.lit(0.0)) >= full
    exact = F.col("max_repeats") * F.col("size") < F.col("target_weight") * F.col("budget_ratio") * F.lit(total)
    share = F.try_divide(F.col("tokens"), F.sum("tokens").over(mine))
    report = both.select("mix_id", "source", "size", "target_weight", (F.col("target_weight") * F.col("budget_ratio") * F.lit(total)).alias("target_tokens"), "turns", "tokens", share.alias("share"), "repeats", (ran_out & exact).alias("failed"))
    return placed.filter("tokens is not null"), report


def reading_order(slots: DataFrame, parts: DataFrame) -> DataFrame:
    """(mix_id, slot, source, repeat, doc_id, first, tokens): the pieces of documents that every slot of mix() reads.

    parts are the blocks() of the same sizes and block length. The join's key holds the block, of which a source has as many
    as its size asks for, so a source with many rows is spread over all tasks.
    """
    at = slots.select("mix_id", "slot", "source", "block", "repeat")
    met = at.alias("l").join(parts.alias("r"), null_safe(at, parts, ["source", "block"], "l", "r"))
    return met.select("l.mix_id", "l.slot", "l.source", "l.repeat", "r.doc_id", "r.first", "r.tokens")


def _plan(sizes: DataFrame, targets: DataFrame) -> tuple[DataFrame, int]:
    """The targets with the sizes of their sources, a written table of as many rows; and the size of all documents."""
    per = materialise(sizes.groupBy("source").agg(F.sum("tokens").alias("size")))
    total = int(per.select(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    want = wanted(targets).fillna(0.0, ["target_weight", "budget_ratio"]).fillna(0, ["max_repeats"])
    plan = want.alias("l").join(per.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")), "left").select("l.*", F.coalesce("r.size", F.lit(0)).cast("bigint").alias("size"))
    return materialise(plan), total


def _inputs(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return materialise(sized(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "mix_targets")


def p8_schedule(spark, sf_dir: str) -> DataFrame:
    """The blocks of every mix in reading order."""
    return mix(*_inputs(spark, sf_dir))[0]


def p8_blocks(spark, sf_dir: str) -> DataFrame:
    """The mixed corpora: the pieces of documents of every mix in reading order."""
    sizes, targets = _inputs(spark, sf_dir)
    return reading_order(mix(sizes, targets)[0], blocks(sizes))


def p8_shares(spark, sf_dir: str) -> DataFrame:
    """Target and actual shares of every mix and source."""
    return mix(*_inputs(spark, sf_dir))[1].withColumn("share", F.round("share", 6)).withColumn("target_tokens", F.round("target_tokens", 3))


def p8_found(spark, sf_dir: str) -> DataFrame:
    """Targets that their source can't fill even when repeated as often as allowed."""
    return mix(*_inputs(spark, sf_dir))[1].filter("failed").select("mix_id", "source")


