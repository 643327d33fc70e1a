"""Reading of names, digests and tags that arrive in several spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks, the separators allowed inside a digest, and the prefixes before one.
BLANKS = " \t\n\r\x0b\f "
SEPARATORS = r"[\s :_.,;/\-]"
PREFIX = r"^[\s ]*(0x|\\x|sha-?256[\s]*[:=]?|hex[:=])"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_name(c: Column | str) -> Column:
    """Lower case without blanks around; null stays null."""
    return F.lower(F.btrim(_col(c), F.lit(BLANKS)))


def hex256(c: Column | str) -> Column:
    """The 64 lower-case hex digits of a digest or tag in any spelling; null when unreadable.

    Letter case, blanks, one prefix and separators don't count; what is then not exactly 64 hex digits is unreadable.
    """
    c = _col(c)
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), PREFIX, ""), SEPARATORS, "")
    return F.when(c.rlike(r"^[0-9a-f]{64}\z"), c).when(bare.rlike(r"^[0-9a-f]{64}\z"), bare)


def tag_bytes_hex(c: Column | str, size: int = 32) -> Column:
    """The hex digits of a binary tag; null when its length is not `size` bytes."""
    c = _col(c)
    return F.when(F.octet_length(c) == size, F.lower(F.hex(c)))
