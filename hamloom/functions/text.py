"""Words, shingles, mail bodies and similarity tags of texts."""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hamloom.functions.keys import _col

#: Domains separate tags from recovery representations. To reproduce tags that another system has stored, pass its domain.
TAG_DOMAIN = "text-tag/v1"
RECOVERY_DOMAIN = "text-recovery/v1"

_WORD = re.compile(rb"[0-9A-Za-z]+")
#: Shingles hashed at once; longer texts are voted in parts.
VOTE_BLOCK = 4096


def words(c: Column | str) -> Column:
    """Runs of ASCII letters and digits in lower case; every other character separates. Null gives null.

    Runs are taken before lowering: lowering other letters could make ASCII ones.
    """
    return F.transform(F.regexp_extract_all(_col(c), F.lit("([0-9A-Za-z]+)"), 1), F.lower)


def normalised(c: Column | str) -> Column:
    """The words of a text joined by one blank."""
    return F.array_join(words(c), " ")


def shingles(word_array: Column, size: int = 3, sep: str = "\x1f") -> Column:
    """Runs of `size` consecutive words joined by sep; an empty array if there are fewer words.

    Shifted copies of the array are zipped, so the words are made `size` times, not once per run.
    """
    n = F.greatest(F.size(word_array) - (size - 1), F.lit(0))
    out = F.slice(word_array, 1, n)
    for k in range(1, size):
        out = F.zip_with(out, F.slice(word_array, k + 1, n), lambda a, b: F.concat(a, F.lit(sep), b))
    return out


def trim_field(c: Column | str) -> Column:
    """Without blanks, tabs and line ends around."""
    return F.btrim(_col(c), F.lit(" \t\r\n"))


def split_fields(c: Column | str, sep: str = ",") -> Column:
    """Fields between separators, each trimmed; empty ones are kept."""
    return F.transform(F.split(_col(c), re.escape(sep), -1), trim_field)


def extract_body(raw: Column | str) -> Column:
    """The text after the first blank line of a mail, line ends made LF and white space around removed; null without one."""
    t = F.replace(_col(raw), F.lit("\r\n"), F.lit("\n"))
    at = F.instr(t, "\n\n")
    return F.when(at > 0, F.regexp_replace(F.substring(t, at + 2, F.length(t)), "^[ \\t\\n\\r\\x0B\\f]+|[ \\t\\n\\r\\x0B\\f]+\\z", ""))


@lru_cache(64)
def field_prefix(domain: str) -> bytes:
    """How a hash over a domain and fields begins: the domain after its length as four big-endian bytes."""
    d = domain.encode()
    return struct.pack(">I", len(d)) + d


def hash_fields(domain: str, *fields: Column) -> Column:
    """SHA-256 (hex) over the domain and binary fields, each after its length as four big-endian bytes."""

    def sized(x: Column) -> Column:
        return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(x).cast("bigint")), 8, "0")), x)

    return F.sha2(F.concat(F.lit(field_prefix(domain)), *[sized(f.cast("binary")) for f in fields]), 256)


@lru_cache(1 << 16)
def _vote(domain: str, feature: bytes) -> bytes:
    """The digest of a shingle; phrases come again and again."""
    return hashlib.sha256(field_prefix(domain) + len(feature).to_bytes(4, "big") + feature).digest()


#: The last tags by domain and digest of the text.
_TAGS: dict[tuple[str, bytes], bytes] = {}
_KEPT = 1 << 14


def simhash(text: bytes, domain: str = TAG_DOMAIN) -> bytes:
    """The 256-bit similarity tag: per bit the majority over the hashes of all word 3-shingles, ties set.

    Bits count from the least significant of each byte. A text of one or two words has its first word as only shingle,
    one without words the word "empty". A text that comes again is not voted again.
    """
    key = domain, hashlib.sha256(text).digest()
    if (tag := _TAGS.get(key)) is None:
        if len(_TAGS) >= _KEPT:
            _TAGS.clear()
        tag = _TAGS[key] = _simhash(text, domain)
    return tag


def _simhash(text: bytes, domain: str) -> bytes:
    w = _WORD.findall(text.lower()) or [b"empty"]
    feats = [w[0]] if len(w) < 3 else [b"\x1f".join(x) for x in zip(w, w[1:], w[2:], strict=False)]
    ones = np.zeros(256, np.int64)
    for lo in range(0, len(feats), VOTE_BLOCK):
        part = b"".join([_vote(domain, f) for f in feats[lo : lo + VOTE_BLOCK]])
        ones += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 32), axis=1, bitorder="little").sum(0, dtype=np.uint16)  # VOTE_BLOCK rows fit
    return np.packbits(2 * ones >= len(feats), bitorder="little").tobytes()


def text_tag(c: Column | str, domain: str = TAG_DOMAIN) -> Column:
    """The similarity tag of a text as lower-case hex; of a null text null. Vectorised, no shuffle."""

    @F.pandas_udf(T.StringType())
    def tag(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else simhash(t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass"), domain).hex() for t in texts], dtype=object)

    return tag(_col(c))


def parse_thresholds(spec: str) -> dict[str, int]:
    """type=distance pairs between commas; default is required, distances are whole numbers from 0 to 255."""
    out: dict[str, int] = {}
    for item in spec.split(","):
        name, sep, value = (x.strip() for x in item.partition("="))
        if not sep or not name or not value.isdigit() or int(value) > 255:
            raise ValueError(f"bad threshold {item!r}")
        out[name] = int(value)
    if "default" not in out:
        raise ValueError("a default threshold is required")
    return out


def threshold_for(type_col: Column | str, spec: str) -> Column:
    """The distance allowed for a type: its own or the default."""
    limits = parse_thresholds(spec)
    m = F.create_map(*[F.lit(x) for k, v in limits.items() if k != "default" for x in (k, v)]) if len(limits) > 1 else None
    return F.lit(limits["default"]) if m is None else F.coalesce(m[_col(type_col)], F.lit(limits["default"]))


def metadata_line(c: Column | str) -> Column:
    """The map of a line such as "records=4, bytes=10": names to values as text."""
    pairs = F.regexp_extract_all(_col(c), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)=([^,\s]+)"), 0)
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1), F.substring_index(p, "=", -1))))


def typed_value(c: Column | str) -> Column:
    """struct(whole, real, text): the one that the text is read as is set: a whole number, else a real one, else text."""
    x = _col(c)
    whole = F.when(x.rlike(r"^[+-]?[0-9]+\z"), x.try_cast("bigint"))
    real = F.when(whole.isNull() & x.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\z"), x.try_cast("double"))
    return F.struct(whole.alias("whole"), real.alias("real"), F.when(whole.isNull() & real.isNull(), x).alias("text"))
