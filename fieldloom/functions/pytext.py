"""String helpers as columns, with the semantics of common scripting-language string methods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value computed once a row and written once in the plan, however often `of` uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end; trim() takes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Non-empty parts between white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")


def lines(c: Column, least: int = 3) -> Column:
    """Stripped lines of at least so many characters."""
    return F.filter(F.transform(F.split(c, LINE_BREAK), strip), lambda x: F.length(x) >= least)


def title(c: Column) -> Column:
    """Upper case after anything that has no case, lower case otherwise (so O'Neil, Mary-Ann)."""
    chars = F.split(c, "")
    before = F.concat(F.array(F.lit(" ")), chars)
    return F.when(c == "", c).otherwise(
        F.array_join(F.zip_with(chars, F.slice(before, F.lit(1), F.size(chars)), lambda x, p: F.when(F.lower(p) != F.upper(p), F.lower(x)).otherwise(F.upper(x))), "")
    )


def matched(c: Column, pattern: str) -> Column:
    """Group 1 of the first match, null without a match (a match may be empty)."""
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, 1))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def present(c: Column) -> Column:
    return c.isNotNull() & (c != "")
