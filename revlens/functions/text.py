"""Scalar text helpers as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Non-blank = has a character that is neither whitespace nor a Unicode
# separator.  Spark's trim() strips spaces only and Java's \s misses the
# no-break space, hence the explicit class.
NONBLANK_RE = r"[^\s\p{Z}]"
EDGE_BLANK_RE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_nonblank(c) -> Column:
    """True when the string has a visible character; NULL input gives False."""
    return F.coalesce(_c(c).rlike(NONBLANK_RE), F.lit(False))


def strip(c) -> Column:
    """Strip leading and trailing whitespace, separators included."""
    return F.regexp_replace(_c(c), EDGE_BLANK_RE, "")


def truncate(c, n: int) -> Column:
    """First ``n`` characters."""
    return F.substring(_c(c), 1, n)


def truncate_ellipsis(c, n: int) -> Column:
    """First ``n`` characters plus '...' only when the text is longer."""
    col = _c(c)
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)


def text_bar(pct, per_block: int = 5) -> Column:
    """A block character repeated int(pct / per_block) times."""
    return F.repeat(F.lit("█"), F.floor(_c(pct) / per_block).cast("int"))


def star_label(n) -> Column:
    """The star character repeated n times."""
    return F.repeat(F.lit("★"), _c(n).cast("int"))
