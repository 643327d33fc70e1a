"""Scores for abusive, hateful or sexual content by compression distance to two zstandard dictionaries."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hamloom.functions.keys import norm_name
from hamloom.session import table

#: The fit takes at most this many labelled documents (those with the smallest hashes).
MAX_LABELLED = 12_000
#: Bytes of a dictionary. Windows of labelled documents that don't fit, the rarest, are left out (README: what that costs).
DICTIONARY = 1_000_000
#: Compression level; the high ones find short matches.
LEVEL = 19
#: Longest window, the overlap of windows cut from a longer sentence, and the length below which a sentence joins another, in characters.
WINDOW, OVERLAP, SHORTEST = 240, 80, 8
#: With this many blanks, a window of a toxic document that the ordinary dictionary can't halve counts as toxic.
NOVEL = 6

# Letters of other scripts that look like Latin ones, and digits and signs used in place of letters.
LOOKALIKES = dict(zip("аеорсхуіјѕԁһӏԛԝвкмнтзбгαοερτυνικѵ", "aeopcxyijsdhlqwbkmht36raoeptuvikv", strict=True))
LEET = str.maketrans("4013578$@", "aoiestbsa")
SENTENCE_END = re.compile(r"(?<=[。！？])|(?<=[.!?;:])[\s\"'”“«»)]+|\t|\s{2,}")
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*!]+(?=[^\W\d_](?![^\W_]))){3,}[^\W\d_](?![^\W_])")
MIXED = re.compile(r"(?<![\w\-/:.,])(?=[\w$@]*[a-z])(?=[\w$@]*[0-9$@])[\w$@]{3,}(?![\w\-])")


def canonical(text: str) -> str:
    """One spelling of a text: compatibility forms, case, accents, invisible characters, look-alike letters, digits for
    letters, letters set apart, stretched letters and wrapped or quoted lines are undone; numbers become 0."""
    t = unicodedata.normalize("NFKC", text)
    if not t.isascii():
        t = "".join(c for c in t if unicodedata.category(c) != "Cf")
        t = "".join(LOOKALIKES.get(c, c) for c in t.lower())
        t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)).replace("ß", "ss").replace("’", "'")
    else:
        t = t.lower()
    t = re.sub(r"\r\n?", "\n", t)
    t = re.sub(r"\n[> \t]*\n", ".  ", t)
    t = re.sub(r"\n[> \t]*", " ", t)
    t = SPACED.sub(lambda m: re.sub(r"[ .\-_*!]+", "", m[0]), t)
    t = MIXED.sub(lambda m: m[0].translate(LEET) if sum(c.isalpha() for c in m[0]) >= 2 else m[0], t)
    t = re.sub(r"([^\W\d_])\1{2,}", r"\1", t)
    t = re.sub(r"([!?.])\1+", r"\1", t)
    return re.sub(r"\d+", "0", t)


def windows(text: str | None) -> list[str]:
    """The distinct sentences of the canonical text. Long ones are cut into overlapping parts; one under SHORTEST characters goes
    with the sentence after it (the last with the one before), so every letter of the text lies in some window."""
    if not text:
        return []
    out: dict[str, None] = {}
    held, last = "", ""
    for s in SENTENCE_END.split(canonical(text)):
        s = s.strip(" >*-\"'\n")
        if held and s:
            s, held = f"{held} {s}", ""
        if 0 < len(s) < SHORTEST:
            held = s
            continue
        while len(s) > WINDOW:
            out[s[:WINDOW]] = None
            s = s[WINDOW - OVERLAP :]
        if s:
            out[s] = None
            last = s
    if held:
        out[f"{last} {held}".strip()[-WINDOW:]] = None
    return list(out)


class Lengths:
    """Compressed lengths of windows under a dictionary made of sample windows."""

    def __init__(self, content: bytes):
        import zstandard as zstd

        self.content = content
        if len(content) < 8:
            content = content.ljust(8, b" ")
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        self._c = zstd.ZstdCompressor(dict_data=d, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
        self._kept: dict[str, int] = {}

    def __call__(self, window: str) -> int:
        n = self._kept.get(window)
        if n is None:
            if len(self._kept) > 200_000:
                self._kept.clear()
            n = self._kept[window] = len(self._c.compress(window.encode("utf-8", "replace")))
        return n


def dictionary(samples: Counter[str], size: int = DICTIONARY) -> bytes:
    """Distinct windows, the most frequent ones last, where matches cost least. Beyond `size` bytes the rarest are left out.

    The windows themselves are the dictionary's content: one trained by zstandard's trainer keeps the fragments that many
    samples share, and insults are rare (README: its figures).
    """
    chosen, used = [], 0
    for w, _ in sorted(samples.items(), key=lambda x: (-x[1], x[0])):
        used += len(w.encode("utf-8", "replace")) + 1
        if used > size:
            break
        chosen.append(w)
    return "\n".join(reversed(chosen)).encode("utf-8", "replace")


def excess(ordinary: Lengths, toxic: Lengths, window: str) -> float:
    """How many bytes the toxic dictionary saves over the ordinary one, per root of the window's length."""
    return (ordinary(window) - toxic(window)) / max(4.0, len(window) ** 0.5)


@dataclass
class Model:
    """Both dictionaries and the calibrated threshold."""

    ordinary: bytes
    toxic: bytes
    threshold: float
    report: dict = field(default_factory=dict)

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores of texts under a model."""

    def __init__(self, model: Model):
        self.ordinary, self.toxic = Lengths(model.ordinary), Lengths(model.toxic)

    def __call__(self, parts: list[str]) -> tuple[float, str]:
        """The largest excess of a document's windows and that window; -1 and "" for a document without windows."""
        best, at = -1.0, ""
        for w in parts:
            s = excess(self.ordinary, self.toxic, w)
            if s > best:
                best, at = s, w
        return round(best, 6), at


def _train(docs: list[tuple[int, list[str]]], rounds: int = 2) -> tuple[Counter, Counter]:
    """The windows for the ordinary and the toxic dictionary from documents (label, windows).

    A label is of a whole document and may be wrong. A window that several documents share is toxic if most of them are
    labelled so. The rest of a toxic document starts as toxic if the ordinary dictionary can't shorten it. Then each
    half of the documents is scored with dictionaries of the other half, by which windows of toxic documents stay or leave
    and plainly toxic windows of wrongly labelled clean documents leave the ordinary side.
    """
    seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for y, parts in docs:
        for w in parts:
            seen[w][y] += 1
    base = sum(y for y, _ in docs) / max(1, len(docs))

    def leaning(w: str) -> int:
        c, a = seen[w]
        if a + c < 2:
            return 0
        return 1 if a >= 3 and a > 2 * c else -1 if a <= max(1.0, 2 * base * (a + c)) and c > a else 0

    start = Lengths(dictionary(Counter({w: c for w, (c, a) in seen.items() if c and leaning(w) <= 0})))
    toxic = {w for w, (c, a) in seen.items() if a and (leaning(w) > 0 or (not c and leaning(w) == 0 and len(w) >= 16 and start(w) > 0.35 * (len(w) + 8)))}
    ordinary = {w for w, (c, a) in seen.items() if c and leaning(w) <= 0}
    for _ in range(rounds):
        sides = []
        for h in (0, 1):
            t, o = Counter(), Counter()
            for y, parts in docs[h::2]:
                for w in parts:
                    if y and w in toxic:
                        t[w] += 1
                    elif not y and w in ordinary:
                        o[w] += 1
            sides.append((Lengths(dictionary(o)), Lengths(dictionary(t))))
        keep_t, keep_o = set(), set()
        for i, (y, parts) in enumerate(docs):
            o, t = sides[1 - i % 2]
            for w in parts:
                lean = leaning(w)
                s = excess(o, t, w)
                if y and (lean > 0 or (lean == 0 and seen[w][1] > 2 * seen[w][0] and (s > 0.5 or (w.count(" ") >= NOVEL and o(w) > 0.5 * len(w))))):
                    keep_t.add(w)
                if not y and lean <= 0 and (lean < 0 or s < 1.0):
                    keep_o.add(w)
        toxic, ordinary = keep_t, keep_o - keep_t
    return Counter({w: sum(seen[w]) for w in ordinary}), Counter({w: seen[w][1] for w in toxic})


def fit(docs: list[tuple[int, list[str]]]) -> Model:
    """Dictionaries from the labelled documents and the threshold that has the best F1 on documents not used for them.

    Two folds: dictionaries of one half score the other; the threshold is the middle of the values with an F1
    within 0.002 of the best. The final dictionaries are made of all documents. Without labels of both kinds the threshold
    is infinite: nothing is found.
    """
    if len({y for y, _ in docs}) < 2:
        return Model(b"", b"", float("inf"), {"documents": len(docs)})
    scores = np.empty(len(docs))
    for k in range(2):
        o, t = _train([d for i, d in enumerate(docs) if i % 2 != k])
        scorer = Scorer(Model(dictionary(o), dictionary(t), 0.0))
        for i in range(k, len(docs), 2):
            scores[i] = scorer(docs[i][1])[0]
    y = np.array([d[0] for d in docs], bool)
    grid = np.unique(np.round(scores[scores > 0.2], 2))
    if not len(grid):
        grid = np.array([1.0])
    f1 = np.array([2 * (y & (scores >= g)).sum() / max(1, (scores >= g).sum() + y.sum()) for g in grid])
    good = grid[f1 >= f1.max() - 0.002]
    threshold = float(np.median(good))
    hit = scores >= threshold
    o, t = _train(docs)
    report = {"documents": len(docs), "toxic": int(y.sum()), "f1": round(float(f1.max()), 4), "precision": round(float((hit & y).sum() / max(1, hit.sum())), 4), "recall": round(float((hit & y).sum() / max(1, y.sum())), 4), "toxic_windows": len(t), "ordinary_windows": len(o)}
    return Model(dictionary(o), dictionary(t), threshold, report)


def labelled(documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> list[tuple[int, list[str]]]:
    """(label, windows) of at most `limit` labelled documents: 1 if more of its verdicts say abusive than clean, 0 if
    fewer; ties, other and null verdicts don't count."""
    v = norm_name("verdict")
    votes = labels.groupBy("doc_id").agg((F.count_if(v == "abusive") - F.count_if(v == "clean")).alias("votes")).filter("votes <> 0")
    some = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most `limit` rows of two numbers

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"doc_id": df["doc_id"], "y": (df["votes"] > 0).astype("int32"), "parts": [windows(t) for t in df["text"]]})

    got = rows.mapInPandas(cut, "doc_id bigint, y int, parts array<string>").toPandas().sort_values("doc_id")
    return [(int(y), list(p)) for y, p in zip(got["y"], got["parts"], strict=True)]


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, source, score, window, abusive) of every document; window is the one that gave the score.

    score is the largest excess of a window; null, empty and blank texts have -1 and are not abusive. The whole text is
    read. No shuffle: the dictionaries, of at most DICTIONARY bytes each, are broadcast. Other columns are dropped.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = shared.value.scorer()
        for df in batches:
            got = [scorer(windows(t)) for t in df["text"]]
            out = df[["doc_id", "source"]].copy()
            out["score"], out["window"] = [g[0] for g in got], [g[1] for g in got]
            out["abusive"] = out["score"] >= shared.value.threshold
            yield out

    rows = documents.select("doc_id", norm_name("source").alias("source"), "text")
    return rows.mapInPandas(score, "doc_id bigint, source string, score double, window string, abusive boolean")


def _scored(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_documents(documents, fit(labelled(documents, table(spark, sf_dir, "review_labels"))))


def p9_scores(spark, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    return _scored(spark, sf_dir).select("doc_id", "source", "score", "abusive")


def p9_rates(spark, sf_dir: str) -> DataFrame:
    """Documents, abusive ones and their rate by source."""
    s = _scored(spark, sf_dir)
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("abusive").alias("abusive"), F.round(F.avg(F.col("abusive").cast("int")), 6).alias("rate"))


def p9_found(spark, sf_dir: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content."""
    return _scored(spark, sf_dir).filter("abusive").select("doc_id")
