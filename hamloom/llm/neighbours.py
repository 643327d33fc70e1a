"""The k most similar bit vectors of every bit vector, by an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from hamloom.functions.bits import WORDS, hamming, with_words, words_of
from hamloom.operators.search import SCAN_BLOCK, blocks_of
from hamloom.operators.store import distinct_tags
from hamloom.session import materialise

#: Codewords of a half are fitted on at most this many tags per codeword (hash order), so on some 2 sqrt(n) tags of n; and
#: the rounds of the fit.
SAMPLE_PER_CODEWORD, ROUNDS = 8, 4
#: A query visits at least PROBES x codewords of the codewords^2 cells of its type.
PROBES = 4
#: Share of the true neighbours of a sample of queries that the visited cells must hold, and the sample's size per type.
RECALL, SAMPLE_QUERIES = 0.97, 512
#: Fewest tags of a region, the unit in which the index is searched; a block of queries, searched in a region at once, is as large.
REGION = 32_768
#: Above REGION squared tags, a region has the root of this many tags per tag of its type.
PAIRS_PER_TAG = 1024


@dataclass
class Codebook:
    """Codewords of one type: k x 2 words for either half."""

    first: np.ndarray
    second: np.ndarray

    @property
    def k(self) -> int:
        return max(len(self.first), len(self.second))


def codewords_for(n: int) -> int:
    """About a quarter of the square root of n, a power of two, so that a cell holds a few tags at any n."""
    return int(max(1, 2 ** int(np.floor(np.log2(max(1.0, np.sqrt(n) / 4))))))


def region_size(n: int) -> int:
    """Tags of a region for a type of n tags.

    A tag is sent to the regions that its query visits and, as an item, once per block of queries: n / size times each
    at most. Comparing n tags at any distance takes up to n^2 / 2 comparisons, n^2 / size^2 tasks; size grows with the root of n
    so that tags are sent about sqrt(n / PAIRS_PER_TAG) times while a task grows to n x PAIRS_PER_TAG comparisons.
    """
    return max(REGION, int(np.sqrt(float(n) * PAIRS_PER_TAG)))


def tag_hash(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of all four words (rows of words), so that tags with equal words in any place still spread."""
    h = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(4):
            # The multipliers of a 64-bit finaliser
            h = (h ^ words[:, j]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(33)
            h = h * np.uint64(0xC4CEB9FE1A85EC53)
            h ^= h >> np.uint64(29)
    return h


def refine(codewords: np.ndarray, sample: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codewords moved to the middle of their cells: per bit the majority of the sample's halves nearest to them, `rounds` times."""
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(len(sample), 16), axis=1)
    for _ in range(rounds):
        near = half_distances(sample, codewords).argmin(1)
        n = np.bincount(near, minlength=len(codewords))
        ones = np.zeros((len(codewords), 128), np.int64)
        np.add.at(ones, near, bits)
        kept = np.unpackbits(codewords.astype(">u8").view(np.uint8).reshape(len(codewords), 16), axis=1)
        # ties and codewords without members stay as they are
        new = np.where(2 * ones > n[:, None], 1, np.where(2 * ones < n[:, None], 0, kept)).astype(np.uint8)
        codewords = np.packbits(new, axis=1).reshape(-1, 2, 8).copy().view(">u8")[:, :, 0].astype(np.uint64)
    return codewords


def half_distances(words: np.ndarray, codewords: np.ndarray) -> np.ndarray:
    """n x k bit distances of n x 2 words to k x 2 codewords."""
    out = np.empty((len(words), len(codewords)), np.int16)
    for j, c in enumerate(codewords):
        out[:, j] = np.bitwise_count(words[:, 0] ^ c[0]) + np.bitwise_count(words[:, 1] ^ c[1]).astype(np.int16)
    return out


def reach(d1: np.ndarray, d2: np.ndarray, cells: int) -> np.ndarray:
    """The summed distance up to which each query must go to visit `cells` centroid pairs.

    The multi-sequence traversal pops pairs in order of d1 + d2. These sums are small integers, so a bucket queue
    takes the place of the binary heap: the pairs of every sum are counted from histograms of the two lists, and the
    traversal ends with the bucket in which the wanted number is reached, its ties included.
    """
    n, top = len(d1), 129
    h1, h2 = np.zeros((n, top), np.int32), np.zeros((n, top), np.int32)
    row = np.arange(n)
    for j in range(d1.shape[1]):
        np.add.at(h1, (row, d1[:, j]), 1)
    for j in range(d2.shape[1]):
        np.add.at(h2, (row, d2[:, j]), 1)
    upto = np.cumsum(h2, 1)
    out = np.full(n, 2 * top, np.int32)
    lo = d1.min(1).astype(np.int32) + d2.min(1)
    want = min(cells, d1.shape[1] * d2.shape[1])
    open_ = np.arange(n)
    for step in range(2 * top):
        s = lo[open_] + step
        # pairs with sum at most s: over every value x of d1, the codewords of the other half within s - x
        left = s[:, None] - np.arange(top)[None, :]
        got = np.where(left >= 0, np.take_along_axis(upto[open_], np.clip(left, 0, top - 1), 1), 0)
        done = (h1[open_] * got).sum(1) >= want
        out[open_[done]] = s[done]
        open_ = open_[~done]
        if not len(open_):
            break
    return out


def cells_before(d1: np.ndarray, d2: np.ndarray, s: np.ndarray) -> np.ndarray:
    """How many centroid pairs of each row have a summed distance below s."""
    upto = np.zeros((len(d2), 129), np.int64)
    row = np.arange(len(d2))
    for j in range(d2.shape[1]):
        np.add.at(upto, (row, d2[:, j]), 1)
    upto = np.cumsum(upto, 1)
    left = s[:, None].astype(np.int32) - 1 - d1
    return np.where(left >= 0, np.take_along_axis(upto, np.clip(left, 0, 128), 1), 0).sum(1)


def _words(df: pd.DataFrame) -> np.ndarray:
    return np.stack([df[w].to_numpy(np.int64).view(np.uint64) for w in WORDS], 1)


def _fit(tags: DataFrame, sizes: dict[str, int]) -> dict[str, Codebook]:
    """Codebooks of every type from its tags with the smallest hashes: at most SAMPLE_PER_CODEWORD x codewords rows each."""
    wanted = {t: codewords_for(n) for t, n in sizes.items()}
    limit = max(wanted.values()) * SAMPLE_PER_CODEWORD
    spread = 1 << 10
    h = F.xxhash64("tag")
    # the smallest hashes of a type lie in the lowest share of the hash range, so only that share is ranked
    share = F.create_map(*[x for t, n in sizes.items() for x in (F.lit(t), F.lit(min(1.0, (8.0 * wanted[t] * SAMPLE_PER_CODEWORD + spread) / n)))])
    some = tags.withColumn("_h", h).filter(F.pmod(F.col("_h"), F.lit(1 << 20)) <= share[F.col("type")] * (1 << 20))
    best = some.withColumn("_r", F.row_number().over(W.partitionBy("type").orderBy("_h", "tag"))).filter(F.col("_r") <= limit)
    rows = best.select("type", "_r", *WORDS).toPandas()
    out = {}
    for t, part in rows.groupby("type", sort=False):
        words = _words(part.sort_values("_r"))
        halves = []
        for cols in (words[:, :2], words[:, 2:]):
            _, at = np.unique(cols, axis=0, return_index=True)
            halves.append(refine(cols[np.sort(at)[: wanted[t]]], cols))
        out[t] = Codebook(*halves)
    return out


def _cells(tags: DataFrame, sizes: dict[str, int], books: dict[str, Codebook], k: int, radius: int, probes: int) -> dict[str, int]:
    """Per type, how many cells a query visits: at least probes x codewords, and as many as hold the share RECALL of the true
    k nearest within radius of SAMPLE_QUERIES tags, which are found by comparing these with all tags.

    A pair counts as held if either end visits the other. Types whose cells are all visited anyway aren't sampled.
    """
    out = {t: probes * book.k for t, book in books.items()}
    open_ = {t: n for t, n in sizes.items() if out[t] < len(books[t].first) * len(books[t].second)}
    if not open_:
        return out
    # another hash than that of the codewords, which are nearer to their cells than other tags
    h = F.xxhash64(F.lit(11), "tag")
    share = F.create_map(*[x for t, n in open_.items() for x in (F.lit(t), F.lit(min(1.0, (8.0 * SAMPLE_QUERIES + 1024) / n)))])
    some = tags.filter(F.col("type").isin(*open_)).withColumn("_h", h).filter(F.pmod(F.col("_h"), F.lit(1 << 20)) <= share[F.col("type")] * (1 << 20))
    best = some.withColumn("_r", F.row_number().over(W.partitionBy("type").orderBy("_h", "tag"))).filter(F.col("_r") <= SAMPLE_QUERIES)
    asked = {t: _words(part) for t, part in best.select("type", *WORDS).toPandas().groupby("type", sort=False)}
    sent = tags.sparkSession.sparkContext.broadcast(asked)  # at most SAMPLE_QUERIES x 32 bytes per type

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for t, part in df.groupby("type", sort=False):
                if t not in sent.value:
                    continue
                q, w = sent.value[t], _words(part)
                d = np.zeros((len(q), len(w)), np.int16)
                for j in range(4):
                    d += np.bitwise_count(q[:, j][:, None] ^ w[:, j][None, :])
                d[d == 0] = 512
                limit = np.partition(d, k - 1, 1)[:, k - 1] if len(w) > k else np.full(len(q), 256)
                x, y = np.nonzero(d <= np.minimum(limit, radius)[:, None])
                found = part.iloc[y][["type", "tag", *WORDS]].copy()
                found["q"], found["distance"] = x.astype(np.int32), d[x, y].astype(np.int32)
                yield found

    words = ", ".join(f"{w} bigint" for w in WORDS)
    near = tags.select("type", "tag", *WORDS).mapInPandas(compare, f"type string, tag string, {words}, q int, distance int")
    rank = F.row_number().over(W.partitionBy("type", "q").orderBy("distance", "tag"))
    truth = near.withColumn("_r", rank).filter(F.col("_r") <= k).select("type", "q", *WORDS).toPandas()
    for t, part in truth.groupby("type", sort=False):
        book, ends = books[t], (asked[t][part["q"].to_numpy()], _words(part))
        d = [(half_distances(w[:, :2], book.first), half_distances(w[:, 2:], book.second)) for w in ends]
        row, needed = np.arange(len(part)), []
        for (d1, d2), (e1, e2) in ((d[0], d[1]), (d[1], d[0])):
            needed.append(cells_before(d1, d2, d1[row, e1.argmin(1)].astype(np.int32) + d2[row, e2.argmin(1)]) + 1)
        at = np.sort(np.minimum(*needed))
        out[t] = max(out[t], int(at[int(np.ceil(RECALL * len(at))) - 1]))
    return out


def _regions(counts: pd.DataFrame, sizes: dict[str, int]) -> dict[str, list[list[int]]]:
    """Per type, the regions of every first codeword: neighbours in number share a region, a large one is cut in parts."""
    out: dict[str, list[list[int]]] = {}
    region = 0
    for t, part in counts.groupby("type", sort=True):
        size, fill = region_size(sizes[t]), 0
        lists = [[] for _ in range(int(part["c1"].max()) + 1)]
        for c, n in sorted(zip(part["c1"], part["n"], strict=True)):
            parts = max(1, -(-n // size))
            if fill and (parts > 1 or fill + n > size):
                region, fill = region + 1, 0
            lists[c] = list(range(region, region + parts))
            if parts > 1:
                region = region + parts
            else:
                fill += n
        region += 1
        out[t] = lists
    return out


def _keep_best(own: np.ndarray, other: np.ndarray, dist: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest (dist, order of other) of every own."""
    at = np.lexsort((order[other], dist, own))
    o = own[at]
    first = np.r_[True, o[1:] != o[:-1]] if len(o) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(o)), 0)) if len(o) else np.zeros(0, int)
    return at[np.arange(len(o)) - start < k]


def search_block(items: np.ndarray, item_cells: np.ndarray, queries: np.ndarray, book: Codebook, far: np.ndarray, k: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, distance) of the best k items of every query and the best k queries of every item within radius,
    over the cells that each query visits. item_cells is c1 * 65536 + c2."""
    d1, d2 = half_distances(queries[:, :2], book.first), half_distances(queries[:, 2:], book.second)
    by_cell = np.argsort(item_cells, kind="stable")
    cells, starts = np.unique(item_cells[by_cell], return_index=True)
    ends = np.r_[starts[1:], len(by_cell)]
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    # lexical order of tags is that of their big-endian words
    def order_of(w: np.ndarray) -> np.ndarray:
        rank = np.empty(len(w), np.int64)
        rank[np.lexsort((w[:, 3], w[:, 2], w[:, 1], w[:, 0]))] = np.arange(len(w))
        return rank

    orders = order_of(items), order_of(queries)
    by_word = [np.ascontiguousarray(queries[:, w]) for w in range(4)]
    bound = np.full(len(queries), radius, np.int16), np.full(len(items), radius, np.int16)

    def squeeze() -> None:
        nonlocal size
        q, i, d = (np.concatenate(x) for x in zip(*got, strict=True))
        a, b = _keep_best(q, i, d, orders[0], k), _keep_best(i, q, d, orders[1], k)
        for own, at, limit in ((q, a, bound[0]), (i, b, bound[1])):
            full = np.bincount(own[at], minlength=len(limit)) >= k
            worst = np.zeros(len(limit), np.int16)
            np.maximum.at(worst, own[at], d[at].astype(np.int16))
            limit[full] = worst[full]
        at = np.union1d(a, b)
        got[:] = [(q[at], i[at], d[at])]
        size = len(at)

    last = -1
    for c, lo, hi in zip(cells.tolist(), starts.tolist(), ends.tolist(), strict=True):
        c1, c2 = c >> 16, c & 0xFFFF
        if c1 != last:
            near = np.flatnonzero(d1[:, c1] <= far)
            slack, rows2, last = far[near] - d1[near, c1], np.ascontiguousarray(d2[near].T), c1
        q = near[rows2[c2] <= slack]
        if not len(q):
            continue
        for part in range(lo, hi, 64):
            i = by_cell[part : min(hi, part + 64)]
            for at in range(0, len(q), 8192):
                qq = q[at : at + 8192]
                d = np.bitwise_count(items[i, 0][:, None] ^ by_word[0][qq][None, :]).astype(np.int16)
                for w in (1, 2, 3):
                    d += np.bitwise_count(items[i, w][:, None] ^ by_word[w][qq][None, :])
                if at == 0 and len(qq) > k:
                    # k queries besides the item itself are no farther than the k + 1st distance
                    bound[1][i] = np.minimum(bound[1][i], np.partition(d, k, 1)[:, k])
                y, x = np.nonzero((d <= bound[0][qq][None, :]) | (d <= bound[1][i][:, None]))
                if len(x):
                    dd = d[y, x]
                    same = dd == 0
                    if same.any():
                        x, y, dd = x[~same], y[~same], dd[~same]
                    got.append((qq[x], i[y], dd))
                    size += len(dd)
                    if size > 1_000_000:
                        squeeze()
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16)
    squeeze()
    return got[0]


def nearest_tags(tags: DataFrame, k: int = 5, radius: int = 256, probes: int = PROBES) -> DataFrame:
    """(type, tag, near, distance, rank): up to k nearest other tags of its type for every tag, none beyond radius.

    tags has (type, tag), tag being 64 lower-case hex digits; repeated rows count once, null types or tags not at all.
    Equal distances are ranked in order of the digits. A tag without another within radius gives no row.

    Method: inverted multi-index. Either 128-bit half is quantised to its nearest codeword; a tag lies in the cell of
    its two codewords. A query visits cells by summed distance until it has seen probes x codewords of them, or as many as
    the recall RECALL takes on a sample of queries (see _cells), and the tags of visited cells are ranked by full distance. As
    all tags are also queries, a pair counts for both ends whichever of them visits the other. The fit uses a bounded sample
    (SAMPLE_PER_CODEWORD per codeword), all tags are indexed. Cells are kept in regions of at most region_size tags (a
    crowded codeword is cut by a hash of the whole tag), queries are sent once to each region that they visit, in hash blocks
    of as many, so a task holds a region and a block. Only the best k per region leave a task. Where near neighbours are rare,
    the wanted recall takes a large share of all cells, and the work grows with nearly n^2 / 2 comparisons.
    """
    spark = tags.sparkSession
    rows = materialise(with_words(tags.filter("type is not null and tag is not null").select("type", "tag").distinct()))
    sizes = {r["type"]: r["n"] for r in rows.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
    schema = T.StructType([T.StructField("type", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("near", T.StringType()), T.StructField("distance", T.IntegerType()), T.StructField("rank", T.IntegerType())])
    if not sizes:
        return spark.createDataFrame([], schema)
    fitted = _fit(rows, sizes)
    books = spark.sparkContext.broadcast(fitted)  # about 8 sqrt(n) bytes for a type of n tags
    cells = _cells(rows, sizes, fitted, k, radius, probes)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for t, part in df.groupby("type", sort=False):
                book, w = books.value[t], _words(part)
                rows_at_once = max(256, (1 << 24) // book.k)
                for at in range(0, len(part), rows_at_once):
                    end = at + rows_at_once
                    d1, d2 = half_distances(w[at:end, :2], book.first), half_distances(w[at:end, 2:], book.second)
                    far = reach(d1, d2, cells[t])
                    out = part.iloc[at:end][["type", *WORDS]].copy()
                    out["c1"], out["c2"], out["far"] = d1.argmin(1).astype(np.int32), d2.argmin(1).astype(np.int32), far
                    out["slack"] = far - d2.min(1)
                    yield out

    words = ", ".join(f"{w} bigint" for w in WORDS)
    placed = materialise(rows.select("type", *WORDS).mapInPandas(assign, f"type string, {words}, c1 int, c2 int, far int, slack int"))
    counts = placed.groupBy("type", "c1").agg(F.count(F.lit(1)).alias("n")).toPandas()  # types x codewords numbers
    plan = spark.sparkContext.broadcast(_regions(counts, sizes))
    split = {t: max(1, -(-n // region_size(n))) for t, n in sizes.items()}

    def to_regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for t, part in df.groupby("type", sort=False):
                lists, w = plan.value[t], _words(part)
                book = books.value[t]
                ids = sorted({r for x in lists for r in x})
                part = part.reset_index(drop=True)
                d1 = half_distances(w[:, :2], book.first)
                goes, place = np.zeros((len(part), len(ids)), bool), {r: i for i, r in enumerate(ids)}
                for c, regions in enumerate(lists):
                    if regions:
                        goes[:, [place[r] for r in regions]] |= (d1[:, c] <= part["slack"].to_numpy())[:, None]
                q, r = np.nonzero(goes)
                out = part.iloc[q][[*WORDS, "far"]].copy()
                out["region"] = np.array(ids, np.int32)[r]
                out["type"] = t
                out["block"] = (tag_hash(w) // np.uint64(3) % np.uint64(split[t])).astype(np.int32)[q]
                yield out[["type", "region", "block", *WORDS, "far"]]

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for t, part in df.groupby("type", sort=False):
                lists, w = plan.value[t], _words(part)
                out = part[[*WORDS]].copy()
                many = np.array([len(lists[c]) for c in part["c1"]], np.uint64)
                first = np.array([lists[c][0] for c in part["c1"]], np.int32)
                out["region"] = first + (tag_hash(w) % many).astype(np.int32)
                out["cell"] = part["c1"].to_numpy(np.int32) * 65536 + part["c2"].to_numpy(np.int32)
                out["type"] = t
                yield out[["type", "region", *WORDS, "cell"]]

    queries = placed.mapInPandas(to_regions, f"type string, region int, block int, {words}, far int")
    items = placed.mapInPandas(index, f"type string, region int, {words}, cell int")
    last = F.create_map(*[x for t, n in split.items() for x in (F.lit(t), F.lit(n - 1))])[F.col("type")]
    items = items.withColumn("block", F.explode(F.sequence(F.lit(0), last)))

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [f"a{i}" for i in range(4)] + [f"b{i}" for i in range(4)]
        a, b = _words(left), _words(right)
        if not len(a) or not len(b):
            return pd.DataFrame({"type": pd.Series([], dtype=str), **{n: pd.Series([], dtype=np.int64) for n in names}, "distance": pd.Series([], dtype=np.int32)})
        q, i, d = search_block(b, right["cell"].to_numpy(np.int64), a, books.value[key[0]], left["far"].to_numpy(np.int32), k, radius)
        out = pd.DataFrame(np.hstack([a[q], b[i]]).view(np.int64), columns=names)
        out["distance"] = d.astype(np.int32)
        out.insert(0, "type", key[0])
        return out

    cols = ", ".join([f"a{i} bigint" for i in range(4)] + [f"b{i} bigint" for i in range(4)])
    by = ["type", "region", "block"]
    pairs = queries.groupBy(*by).cogroup(items.groupBy(*by)).applyInPandas(search, f"type string, {cols}, distance int")
    # 32 bytes a tag, whose order is that of the hex digits
    raw = lambda p: F.unhex(F.concat(*[F.lpad(F.hex(f"{p}{i}"), 16, "0") for i in range(4)]))
    ends = F.array(F.struct(raw("a").alias("tag"), raw("b").alias("near")), F.struct(raw("b").alias("tag"), raw("a").alias("near")))
    both = pairs.select("type", F.explode(ends).alias("e"), "distance").select("type", "e.tag", "e.near", "distance")
    # a pair that was met from both ends comes twice with one dense rank; both rows lie in one partition
    rank = F.dense_rank().over(W.partitionBy("type", "tag").orderBy("distance", "near"))
    best = both.withColumn("rank", rank).filter(F.col("rank") <= k).distinct()
    return best.select("type", F.lower(F.hex("tag")).alias("tag"), F.lower(F.hex("near")).alias("near"), "distance", "rank")


def p2_neighbours(spark, sf_dir: str, k: int = 5) -> DataFrame:
    """The five nearest tags of every tag, at whatever distance."""
    return nearest_tags(distinct_tags(spark, sf_dir).select("type", "tag"), k)


def p2_recall(spark, sf_dir: str, k: int = 5, every: int = 50, least: float = 0.95) -> DataFrame:
    """(type, queries, wanted, reached): how p2_neighbours fares against brute force for the tags whose smallest record_id is
    divisible by `every`: their number, their true neighbours, and whether it gives at least the share `least` of these.

    The stated tags go past all others in broadcast blocks (see operators.search.blocks_of).
    """
    tags = materialise(with_words(distinct_tags(spark, sf_dir).select("type", "tag", "record_id")))
    asked = tags.filter(F.col("record_id") % every == 0)
    near = nearest_tags(tags.select("type", "tag"), k).select("type", "tag", "near")
    d = hamming(words_of(alias="r"), words_of(alias="q"))
    best = None
    for part in blocks_of(asked.select("type", "tag", *WORDS), SCAN_BLOCK):
        met = tags.alias("r").join(F.broadcast(part).alias("q"), (F.col("r.type") == F.col("q.type")) & (F.col("r.tag") != F.col("q.tag")))
        rows = met.select("q.type", "q.tag", F.col("r.tag").alias("near"), d.alias("distance"))
        best = rows if best is None else best.unionByName(rows)
    rank = F.row_number().over(W.partitionBy("type", "tag").orderBy("distance", "near"))
    truth = best.withColumn("_r", rank).filter(F.col("_r") <= k).select("type", "tag", "near")
    hit = truth.join(near.withColumn("hit", F.lit(1)), ["type", "tag", "near"], "left")
    per = hit.groupBy("type").agg(F.countDistinct("tag").alias("queries"), F.count(F.lit(1)).alias("wanted"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))
    return per.select("type", "queries", "wanted", (F.col("found") >= F.col("wanted") * F.lit(least)).alias("reached"))


def p2_found(spark, sf_dir: str, k: int = 5, radius: int = 48) -> DataFrame:
    """Pairs within radius of which one is among the k nearest of the other; the radius is applied before the ranking,
    which it can't change, for it drops only the farthest."""
    near = nearest_tags(distinct_tags(spark, sf_dir).select("type", "tag"), k, radius)
    return near.select("type", F.least("tag", "near").alias("tag_a"), F.greatest("tag", "near").alias("tag_b")).distinct()
