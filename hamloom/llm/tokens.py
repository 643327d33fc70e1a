"""Token ids of texts by a public byte-level tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hamloom.session import table

#: Where the public rank files lie; a parameter of every operator here.
TOKENIZERS = os.environ.get("HAMLOOM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that cuts a text into pieces before byte pairs are merged (it belongs to the vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts longer than this many characters are cut at safe boundaries before they are encoded.
PIECE_CHARS = 20_000

#: Fixed value: separators that Python counts as white space and the pattern doesn't.
NO_SPACE = "\x1c\x1d\x1e\x1f"

_made: dict[bytes, object] = {}


def read_ranks(path: str) -> bytes:
    """The bytes of a rank file (a few hundred kB), read by the driver and sent to every executor."""
    with open(path, "rb") as f:
        return f.read()


def encoder(ranks: bytes):
    """The tiktoken encoding of a rank file, made once per worker process."""
    import tiktoken

    key = ranks[:64] + str(len(ranks)).encode()
    if key not in _made:
        pairs = (line.split() for line in ranks.splitlines() if line)
        _made[key] = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return _made[key]


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut text into pieces of about `size` characters whose encodings concatenate to that of the text.

    A cut is made only between a character that is no white space and white space after it. No piece of the pattern
    spans such a place: white space only begins pieces or makes up whole ones, and the pattern looks ahead only from
    white space. Without such a place the piece goes on.
    """
    start, n = 0, len(text)
    while n - start > size:
        at = start + size
        while at < n and not (text[at].isspace() and text[at] not in NO_SPACE and not text[at - 1].isspace()):
            at += 1
        if at >= n:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def encode_text(enc, text: str | None) -> list[int]:
    """The ids of a text without special tokens; an empty list for an empty or null one."""
    if not text:
        return []
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for piece in safe_pieces(text):
        out += enc.encode_ordinary(piece)
    return out


def token_udf(spark, returns: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """A vectorised function of a text column: its ids ("ids") or their number ("count")."""
    ranks = spark.sparkContext.broadcast(read_ranks(f"{folder}/{name}.tiktoken"))  # one vocabulary file

    if returns == "ids":

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def ids(texts: pd.Series) -> pd.Series:
            enc = encoder(ranks.value)
            return pd.Series([encode_text(enc, t) for t in texts])

        return ids

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        enc = encoder(ranks.value)
        return pd.Series([len(encode_text(enc, t)) for t in texts], dtype="int64")

    return count


def encode(df: DataFrame, text: str = "text", out: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Add `out`, the list of token ids of every text. Empty and null texts give an empty list. No shuffle."""
    return df.withColumn(out, token_udf(df.sparkSession, "ids", name, folder)(F.col(text)))


def count_tokens(df: DataFrame, text: str = "text", out: str = "tokens", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Add `out`, the number of tokens of every text; 0 for empty and null texts. No shuffle."""
    return df.withColumn(out, token_udf(df.sparkSession, "count", name, folder)(F.col(text)))


def decode(df: DataFrame, ids: str = "ids", out: str = "bytes", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Add `out`, the raw bytes of a list of ids: bytes, since a cut list may end inside a character. Null gives null."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(f"{folder}/{name}.tiktoken"))

    @F.pandas_udf(T.BinaryType())
    def to_bytes(lists: pd.Series) -> pd.Series:
        enc = encoder(ranks.value)
        return pd.Series([None if x is None else enc.decode_bytes(list(map(int, x))) for x in lists])

    return df.withColumn(out, to_bytes(F.col(ids)))


def p7_ids(spark, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p7_round_trip(spark, sf_dir: str) -> DataFrame:
    """Number of documents whose ids decode to their own bytes, and of all documents."""
    back = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    same: Column = F.decode("bytes", "UTF-8") == F.coalesce("text", F.lit(""))
    return back.agg(F.count(F.lit(1)).alias("documents"), F.count_if(same).alias("restored"))
