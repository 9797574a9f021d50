"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docutally.schemas import MONEY


def trim_all(text) -> Column:
    """Strip every kind of white space (line breaks, tabs, no-break spaces) from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text) -> Column:
    """True for null, empty or all-white-space text."""
    return ~F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).rlike(r"(?U)\S")


def word_count(text) -> Column:
    """Number of white-space separated words; 0 for blank text."""
    return F.when(is_blank(text), F.lit(0)).otherwise(F.size(F.split(trim_all(text), r"(?U)\s+")))


def norm_text(text) -> Column:
    """Comparable text: single spaces, no outer space, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def norm_number(text) -> Column:
    """Comparable number: ``$1,250.00``, ``1250.00``, ``1250`` and ``1.25e3`` become equal.

    The text as it stands comes first; signs and words around a number are dropped only where that is none.
    """
    text = F.col(text) if isinstance(text, str) else text
    bare = F.when(~text.rlike(r"\d[eE][+-]?\d"), F.regexp_replace(text, r"[^0-9.\-]", ""))
    return F.coalesce(F.trim(text).try_cast(MONEY), bare.try_cast(MONEY))


def same_number(left, right) -> Column:
    """Whether two amounts agree: both absent, or equal as numbers.

    Text that is no number, or one that cannot be held, equals only the same text.
    """
    readable = norm_number(left).isNotNull() & norm_number(right).isNotNull()
    return F.when(readable, norm_number(left) == norm_number(right)).otherwise(plain(left).eqNullSafe(plain(right)))

def plain(text) -> Column:
    """Null for missing or blank text, otherwise the text without outer white space."""
    return F.nullif(trim_all(text), F.lit(""))


def hash_fraction(*parts) -> Column:
    """A number in [0, 1) that depends only on ``parts``."""
    return hash_draw(*parts) / F.lit(float(2**32))


def hash_draw(*parts) -> Column:
    """A 32-bit whole number that depends only on ``parts``."""
    digest = F.md5(F.concat_ws(":", *[F.col(p) if isinstance(p, str) else p for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def sha256_mod_10000(text) -> Column:
    """The SHA-256 of ``text``, read as one 256-bit number, modulo 10,000.

    The digest is folded 32 bits at a time, since 2**32 % 10000 = 7296.
    """
    digest = F.sha2(text, 256)
    rest = F.lit(0).cast("bigint")
    for i in range(8):
        chunk = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")
        rest = (rest * 7296 + chunk) % 10000
    return rest
