"""Normal forms of names, addresses, phone numbers, dates and genders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import latin
from .dictionaries import EXPANSIONS, GENDERS, MONTHS, STOP_TOKENS, lookup
from .pytext import once, present, squeeze, strip, tokens

_DIGITS = "०१२३४५६७८९"
@F.pandas_udf(StringType())
def to_latin(s: pd.Series) -> pd.Series:
    """Latin letters of any script, no control characters; null and empty give the empty string."""
    return s.map(lambda x: "" if x is None else x if x.isascii() and x.isprintable() else latin.to_latin(x))


def digits(c: Column) -> Column:
    """Digits alone, Devanagari ones as ASCII; null gives the empty string."""
    return F.coalesce(F.regexp_replace(F.translate(c, _DIGITS, "0123456789"), r"(?U)\D", ""), F.lit(""))


def expand(c: Column) -> Column:
    """Tokens in lower case, trailing punctuation off, expanded by the table."""
    bare = F.transform(tokens(F.lower(c)), lambda w: F.regexp_replace(w, r"(?U)^(\w+)[^\w]*$", "$1"))
    return F.array_join(F.transform(bare, lambda w: F.coalesce(lookup(EXPANSIONS, w), w)), " ")


def drop_stop_tokens(c: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in STOP_TOKENS])
    return F.array_join(F.filter(tokens(c), lambda w: ~F.array_contains(stop, w)), " ")


def generic(latin: Column) -> Column:
    """Of a text in Latin letters: lower case, punctuation out, tokens expanded, stop tokens out."""
    bare = squeeze(F.regexp_replace(F.lower(F.coalesce(latin, F.lit(""))), r"""[.,;:!?\-()"'/]""", " "))
    return squeeze(drop_stop_tokens(expand(bare)))


def gender(c: Column) -> Column:
    key = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.coalesce(lookup(GENDERS, key), key)


def _date(y: Column, m: Column, d: Column) -> Column:
    """ISO date of three strings or numbers, null if there is no such day; two-digit years from 69 are 19xx."""
    y, m, d = (x.try_cast("int") for x in (y, m, d))
    return F.date_format(F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"), "yyyy-MM-dd")


def _century(y: Column) -> Column:
    n = y.try_cast("int")
    return F.when(F.length(y) == 2, F.when(n >= 69, n + 1900).otherwise(n + 2000)).otherwise(n).cast("string")


def iso_date(c: Column) -> Column:
    """ISO date of common day-first, year-first and month-name forms; the empty string if none fits."""
    s = F.regexp_replace(F.translate(strip(F.coalesce(c, F.lit(""))), "./", "--"), r"(?U)[^\w\s\-:,]", "")
    low = F.lower(s)
    month = "(" + "|".join(MONTHS) + ")(?:[a-z]*)"
    forms = []
    dmy = r"^(\d{1,2})-(\d{1,2})-(\d{4}|\d{2})$"
    forms.append(F.when(F.regexp_like(s, F.lit(dmy)), _date(_century(F.regexp_extract(s, dmy, 3)), F.regexp_extract(s, dmy, 2), F.regexp_extract(s, dmy, 1))))
    ymd = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    forms.append(F.when(F.regexp_like(s, F.lit(ymd)), _date(F.regexp_extract(s, ymd, 1), F.regexp_extract(s, ymd, 2), F.regexp_extract(s, ymd, 3))))
    for p, y, m, d in (
        (rf"^(\d{{1,2}})\s+{month},?\s+(\d{{4}})$", 3, 2, 1),
        (rf"^(\d{{1,2}})-{month}-(\d{{4}}|\d{{2}})$", 3, 2, 1),
        (rf"^{month}\s+(\d{{1,2}}),\s*(\d{{4}})$", 3, 1, 2),
    ):
        number = lookup(MONTHS, F.regexp_extract(low, p, m)).cast("string")
        forms.append(F.when(F.regexp_like(low, F.lit(p)), _date(_century(F.regexp_extract(low, p, y)), number, F.regexp_extract(low, p, d))))
    nums = F.filter(F.split(s, r"[-\s:]"), lambda t: F.regexp_like(t, F.lit(r"^\d{1,4}$")))
    three = F.size(nums) == 3
    for y, m, d in ((2, 1, 0), (0, 1, 2)):
        forms.append(F.when(three, _date(F.get(nums, F.lit(y)), F.get(nums, F.lit(m)), F.get(nums, F.lit(d)))))
    return F.coalesce(*forms, F.lit(""))


def loose_date(c: Column) -> Column:
    """struct(ymd, md) of a date in any order of words and numbers, day first unless the first number is a year.

    Two-digit years are 20xx; a later word that is no month takes the month back; nothing is checked for range.
    """
    low = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"dob[^0-9a-z]+", " ")
    number = F.lit(r"^[0-9]{1,9}$")

    def two(x: Column) -> Column:
        return F.when(x < 10, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))

    def read(parts: Column) -> Column:
        nums = F.transform(F.filter(parts, lambda t: F.regexp_like(t, number)), lambda t: t.try_cast("int"))
        word = F.try_element_at(F.filter(parts, lambda t: ~F.regexp_like(t, number)), F.lit(-1))
        return F.struct(nums.alias("nums"), lookup(MONTHS, F.left(word, F.lit(3))).alias("mon"))

    def placed(found: Column) -> Column:
        nums, mon = found["nums"], found["mon"]
        n, a, b, z = F.size(nums), F.get(nums, F.lit(0)), F.get(nums, F.lit(1)), F.get(nums, F.lit(2))
        year_first = (n == 3) & (a > 1900)
        year = F.when(year_first, a).when(n == 3, z).when((n == 2) & mon.isNotNull(), b)
        month = F.when(n == 3, b).when((n == 2) & mon.isNull(), b).otherwise(mon)
        day = F.when(year_first, z).when(n.isin(2, 3), a).when((n == 1) & mon.isNotNull(), a)
        return F.struct(F.when(year < 100, year + 2000).otherwise(year).alias("y"), month.alias("m"), day.alias("d"))

    def shown(at: Column) -> Column:
        year, month, day = at["y"], at["m"], at["d"]
        some = (F.coalesce(day, F.lit(0)) != 0) & (F.coalesce(month, F.lit(0)) != 0)
        md = F.when(some, F.concat(two(month), F.lit("-"), two(day))).otherwise("")
        ymd = F.when(some & (F.coalesce(year, F.lit(0)) != 0), F.concat(F.format_string("%04d", year), F.lit("-"), two(month), F.lit("-"), two(day))).otherwise("")
        return F.struct(ymd.alias("ymd"), md.alias("md"))

    parts = tokens(F.translate(low, "./-,", "    "))
    return once(once(once(parts, read), placed), shown)


def date_digits(c: Column) -> Column:
    d = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\D", "")
    long = F.when(F.length(d) == 6, F.concat(F.substring(d, 1, 4), F.lit("20"), F.substring(d, 5, 2))).otherwise(d)
    return F.when(F.length(long) == 7, F.concat(F.lit("0"), long)).otherwise(long)


def national_number(d: Column) -> Column:
    """Last ten digits."""
    return F.right(d, F.lit(10))


def age_note(dob: Column, age: Column, as_of: Column) -> Column:
    """Note on a stated age that differs by more than a year from the one on as_of, or can't be read; else null."""
    dmy, ymd = r"^(\d{1,2})-(\d{1,2})-(\d{4}|\d{2})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    s = F.translate(strip(dob), "/", "-")
    born = F.coalesce(
        F.when(F.regexp_like(s, F.lit(dmy)), _date(_century(F.regexp_extract(s, dmy, 3)), F.regexp_extract(s, dmy, 2), F.regexp_extract(s, dmy, 1))),
        F.when(F.regexp_like(s, F.lit(ymd)), _date(F.regexp_extract(s, ymd, 1), F.regexp_extract(s, ymd, 2), F.regexp_extract(s, ymd, 3))),
    )
    derived = (F.datediff(as_of, born.cast("date")) / F.lit(365.25)).cast("int")
    stated = strip(F.translate(age, _DIGITS, "0123456789")).try_cast("int")
    note = F.when(stated.isNull(), F.lit("age_parse_error")).when(F.abs(derived - stated) > 1, F.format_string("age_mismatch(derived=%d, stated=%d)", derived, stated))
    return F.when(present(dob) & present(age) & born.isNotNull(), note)
