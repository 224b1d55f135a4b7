"""Text helpers shared by parsing, classification and search.

All helpers take and return ``Column`` objects and compile to built-in Spark
expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's ``str.strip()``/``str.split()`` whitespace: Unicode White_Space plus
# the four ASCII information separators (U+001C..U+001F).
WS_CLASS = r"(?U)[\s\x1c-\x1f]"
# The same set as explicit characters, derived from Python's own definition.
WS_CHARS = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def strip_ws(col: Column) -> Column:
    """Trim leading and trailing whitespace the way Python's ``str.strip`` does.

    Spark's ``trim`` removes only the space character; ``btrim`` with the
    explicit character set needs no regular expression.
    """
    return F.btrim(col, F.lit(WS_CHARS))


def split_words(col: Column) -> Column:
    """Whitespace split of an already stripped string (Python ``str.split()``)."""
    return F.split(col, rf"{WS_CLASS}+")


def safe_pattern(pattern: Column) -> Column:
    """Make a LIKE pattern safe for Spark's default ``\\`` escape.

    Spark raises on a backslash that escapes anything but ``%``, ``_`` or
    ``\\``; PostgreSQL reads ``\\y`` as ``y``. Escape pairs are consumed left to
    right, a valid pair is kept and a stray backslash is dropped.
    """
    return F.regexp_replace(pattern, r"(\\[%_\\])|\\(.)", "$1$2")


def contains_pattern(keyword: Column) -> Column:
    """The ``'%' || keyword || '%'`` pattern of the keyword join, made safe."""
    return safe_pattern(F.concat(F.lit("%"), keyword, F.lit("%")))


def contains_any(lowered: Column, words: list[str]) -> Column:
    """True when the (already lower-cased) text contains any of ``words``."""
    cond = F.lit(False)
    for w in words:
        cond = cond | lowered.contains(w)
    return cond
