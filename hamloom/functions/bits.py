"""Bit operations on tags, all as built-in expressions.

A tag is its lower-case hex string; for arithmetic it becomes an array of big-endian 64-bit words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hamloom.functions.keys import _col

WORDS = ("w0", "w1", "w2", "w3")


def word(hex_col: Column | str, i: int) -> Column:
    """Word i (16 hex digits) as a signed 64-bit integer with the same bits."""
    return F.conv(F.substring(_col(hex_col), 16 * i + 1, 16), 16, -10).cast("bigint")


def with_words(df, hex_col: str = "tag", prefix: str = ""):
    """Add the four words of a 256-bit tag."""
    return df.withColumns({prefix + w: word(hex_col, i) for i, w in enumerate(WORDS)})


def xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def hamming(a: list[Column], b: list[Column]) -> Column:
    """Number of differing bits of two word lists."""
    return reduce(lambda x, y: x + y, [F.bit_count(xor(p, q)) for p, q in zip(a, b, strict=True)])


def words_of(prefix: str = "", alias: str | None = None) -> list[Column]:
    dot = f"{alias}." if alias else ""
    return [F.col(f"{dot}{prefix}{w}") for w in WORDS]


def distance_until(a: Column | str, b: Column | str, limit: int) -> Column:
    """Differing bits of two hex tags of one length, byte by byte until they exceed limit: exact up to it, else a count above it."""
    a, b = _col(a), _col(b)

    def step(acc: Column, i: Column) -> Column:
        byte = lambda x: F.conv(F.substring(x, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
        return F.when(acc > limit, acc).otherwise(acc + F.bit_count(byte(a).bitwiseXOR(byte(b))))

    return F.when(F.length(a) > 0, F.aggregate(F.sequence(F.lit(0), (F.length(a) / 2 - 1).cast("int")), F.lit(0), step)).otherwise(F.lit(0))


def weight(words: list[Column]) -> Column:
    """Number of set bits."""
    return reduce(lambda x, y: x + y, [F.bit_count(w) for w in words])


def differing_bytes(a: list[Column], b: list[Column]) -> Column:
    """Number of byte positions at which two word lists differ: each byte's bits are folded into its lowest."""

    # an unsigned shift carries bits into the next lower byte; masking the upper nibbles first prevents it
    def byte_any(x: Column) -> Column:
        low = F.lit(0x0F0F0F0F0F0F0F0F).cast("bigint")
        nib = x.bitwiseAND(low).bitwiseOR(F.shiftrightunsigned(x, 4).bitwiseAND(low))
        two = nib.bitwiseOR(F.shiftrightunsigned(nib, 2)).bitwiseAND(F.lit(0x0303030303030303).cast("bigint"))
        one = two.bitwiseOR(F.shiftrightunsigned(two, 1)).bitwiseAND(F.lit(0x0101010101010101).cast("bigint"))
        return F.bit_count(one)

    return reduce(lambda x, y: x + y, [byte_any(xor(p, q)) for p, q in zip(a, b, strict=True)])


def segment_bounds(bits: int, parts: int) -> list[tuple[int, int]]:
    """Bounds of `parts` consecutive segments: [bits*j // parts, bits*(j+1) // parts)."""
    return [(bits * j // parts, bits * (j + 1) // parts) for j in range(parts)]


def _bits_between(c: Column, lo: int, hi: int) -> Column:
    """Bits lo to hi of a hex string as an integer; at most 57 bits.

    At most 16 hex digits are read, so the integer has the bits after a shift and a mask.
    """
    first, last = lo // 4, (hi - 1) // 4
    v = F.conv(F.substring(c, first + 1, last - first + 1), 16, -10).cast("bigint")
    return F.shiftrightunsigned(v, 4 * (last + 1) - hi).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("bigint"))


#: Bits that are read at once from a wider segment: whole bytes.
CHUNK = 56


def _chunks(c: Column, lo: int, hi: int) -> list[tuple[Column, int]]:
    return [(_bits_between(c, at, min(at + CHUNK, hi)), min(at + CHUNK, hi) - at) for at in range(lo, hi, CHUNK)]


def segment_keys(hex_col: Column | str, bits: int, parts: int) -> Column:
    """Array of (segment, value) to join on: segments with equal bits have equal values.

    The value is the segment's bits as an integer where all segments have at most 57 bits, and a 64-bit hash of its bits
    otherwise: a join verifies the distance anyway. segment_blobs has the bits themselves.
    """
    c = _col(hex_col)
    bounds = segment_bounds(bits, parts)
    wide = max(hi - lo for lo, hi in bounds) > 57
    value = [F.xxhash64(*[v for v, _ in _chunks(c, lo, hi)]) if wide else _bits_between(c, lo, hi) for lo, hi in bounds]
    return F.array(*[F.struct(F.lit(j).cast("bigint").alias("segment"), v.alias("value")) for j, v in enumerate(value)])


def segment_blob(hex_col: Column | str, lo: int, hi: int) -> Column:
    """Bits lo to hi as bytes: their number as four little-endian bytes, then the bits, most significant first, left-aligned."""
    head = F.lit((hi - lo).to_bytes(4, "little"))
    out = []
    for v, n in _chunks(_col(hex_col), lo, hi):
        pad = -n % 8
        out.append(F.lpad(F.hex(F.call_function("shiftleft", v, F.lit(pad))), (n + pad) // 4, F.lit("0")))
    return F.concat(head, F.unhex(F.concat(*out)))


def segment_blobs(hex_col: Column | str, bits: int, parts: int) -> Column:
    """Array of (segment, value binary): the stored form of every segment, at any width."""
    return F.array(*[F.struct(F.lit(j).cast("bigint").alias("segment"), segment_blob(hex_col, lo, hi).alias("value")) for j, (lo, hi) in enumerate(segment_bounds(bits, parts))])
