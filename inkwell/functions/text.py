"""Column functions over text with explicit character classes, so that Spark, DuckDB and the documented rules agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that the text rules mean by \\s, for use inside a character class.
WS = " \t\n\x0b\x0c\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same characters one by one: cutting them off looks at a text's ends only, while a pattern is tried at every character of it.
BLANKS = WS.replace("\u2000-\u200a", "".join(map(chr, range(0x2000, 0x200B))))
#: Characters that show nothing.
INVISIBLE = "\u200b\u200c\u200d\ufeff\u00ad"
NBSP = "\u00a0"
#: Full-width letters and digits and what they become.
WIDE = "".join(chr(c) for a, b in ((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)) for c in range(a, b + 1))
#: The same letters and digits inside a character class: a pattern tries the members of a class one after the other.
WIDE_CLASS = "０-９Ａ-Ｚａ-ｚ"
NARROW = "".join(chr(ord(c) - 0xFEE0) for c in WIDE)
CJK = "一-龥"


def trim(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def trim_start(x: Column) -> Column:
    return F.ltrim(x, F.lit(BLANKS))


def trim_end(x: Column) -> Column:
    return F.rtrim(x, F.lit(BLANKS))


def ends(x: Column, n: int, pattern: str) -> Column:
    """Whether the last n characters of x, or all if it has fewer, match; a pattern for an end alone is tried at every character."""
    return F.right(x, F.lit(n)).rlike(pattern)


def is_ascii(x: Column) -> Column:
    return F.octet_length(x) == F.length(x)


def count(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def without_code(x: Column) -> Column:
    """Drops `code` spans where the back ticks are even in number."""
    return F.when(count(x, "`") % 2 == 0, F.regexp_replace(x, "`[^`]*`", "")).otherwise(x)


def clean(x: Column) -> Column:
    """No invisible characters, no-break spaces as spaces, full-width letters and digits as plain ones."""
    return F.translate(F.replace(F.regexp_replace(x, f"[{INVISIBLE}]", ""), F.lit(NBSP), F.lit(" ")), WIDE, NARROW)


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))
