"""Scores of field pairs, 0 to 1. All but the fuzzy ratios are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..functions.fuzzy import best_of
from ..functions.pytext import tokens

name_ratio = best_of("ratio", "token_sort_ratio", "partial_ratio")
address_ratio = best_of("token_sort_ratio", "token_set_ratio", "weighted_ratio", "partial_ratio")


def name_score(a: Column, b: Column, fuzzy: Column | None = None) -> Column:
    """Of two generic normal forms; a is the document's side, which alone may lack a last token."""
    best = (name_ratio(a, b) if fuzzy is None else fuzzy) / 100.0
    la, lb = F.length(F.replace(a, F.lit(" "), F.lit(""))), F.length(F.replace(b, F.lit(" "), F.lit("")))
    short, long = F.least(la, lb), F.greatest(la, lb)
    best = F.when((short <= 2) & (long >= 4), F.least(best, F.lit(0.35))).otherwise(best)
    best = F.when(long / F.greatest(F.lit(1), short) >= 2.5, best * 0.6).otherwise(best)
    ta, tb = tokens(a), tokens(b)
    na, nb = F.size(ta), F.size(tb)

    def at(t: Column, i: int) -> Column:
        return F.try_element_at(t, F.lit(i))

    same_set = (F.size(F.array_except(ta, tb)) == 0) & (F.size(F.array_except(tb, ta)) == 0) & (na == nb)
    cut = (na == nb - 1) & (F.slice(ta, F.lit(1), F.greatest(na - 1, F.lit(0))) == F.slice(tb, F.lit(1), F.greatest(na - 1, F.lit(0)))) & F.startswith(at(tb, -1), at(ta, -1))
    two = (na == 2) & (nb == 2)
    initial = two & (at(ta, 1) == at(tb, 1)) & (F.startswith(at(ta, 2), at(tb, 2)) | F.startswith(at(tb, 2), at(ta, 2)))
    middle = (na == 3) & (nb == 3) & (at(ta, 1) == at(tb, 1)) & (at(ta, 3) == at(tb, 3)) & (F.left(at(ta, 2), F.lit(1)) == F.left(at(tb, 2), F.lit(1)))
    turned = two & (at(ta, 1) == at(tb, 2)) & (at(ta, 2) == at(tb, 1))
    floor = F.greatest(
        F.when(same_set | turned, 0.95).otherwise(0.0), F.when(cut | initial, 0.87).otherwise(0.0), F.when(middle, 0.9).otherwise(0.0)
    )
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest(best, floor))


def token_overlap(a: Column, b: Column) -> dict[str, Column]:
    """Set terms of two normal forms: shared and all tokens, coverage of the larger set, shared numbers."""
    ta, tb = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    shared = F.size(F.array_intersect(ta, tb))
    num_a, num_b = (F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)\b(\d+)\b"), F.lit(1))) for c in (a, b))
    return {
        "shared": shared,
        "all": F.size(F.array_union(ta, tb)),
        "coverage": shared / F.greatest(F.lit(1), F.size(ta), F.size(tb)),
        "numbers": F.size(F.array_intersect(num_a, num_b)),
    }


def address_score(a: Column, b: Column, fuzzy: Column | None = None) -> Column:
    raw = (address_ratio(a, b) if fuzzy is None else fuzzy) / 100.0
    t = token_overlap(a, b)
    numbers = F.least(F.lit(0.05), F.lit(0.02) * t["numbers"])
    jaccard = F.least(F.lit(0.05), F.lit(0.05) * (t["shared"] / F.greatest(F.lit(1), t["all"])))
    coverage = F.greatest(F.lit(0.5), F.when(raw >= 0.9, 1.0).otherwise(t["coverage"]))
    score = F.least(F.lit(1.0), raw * coverage + F.least(F.lit(0.08), numbers + jaccard))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(score)


def phone_score(a: Column, b: Column) -> Column:
    """Of two strings of digits."""
    x, y = N.national_number(a), N.national_number(b)
    width = F.greatest(F.length(x), F.length(y))
    pairs = F.zip_with(F.split(F.lpad(x, width, F.lit("0")), ""), F.split(F.lpad(y, width, F.lit("0")), ""), lambda p, q: F.when(p != q, 1).otherwise(0))
    off = F.aggregate(pairs, F.lit(0), lambda s, v: s + v) + F.abs(F.length(x) - F.length(y))
    out = F.when((a == "") | (b == ""), F.lit(0.0)).when((a == b) | (x == y), F.lit(1.0))
    for k, value in ((9, 0.95), (8, 0.9), (7, 0.85), (6, 0.8)):
        out = out.when((F.length(a) >= k) & (F.length(b) >= k) & (F.right(a, F.lit(k)) == F.right(b, F.lit(k))), F.lit(value))
    return out.otherwise(F.greatest(F.lit(0.0), 1 - off / F.greatest(F.lit(6), width)))


def dob_score(a: Column, b: Column, strict: bool = False) -> Column:
    """1 if the dates agree, or day and month do (not with strict), or the digits do; of two date_forms()."""
    full = (a["ymd"] != "") & (a["ymd"] == b["ymd"])
    day = (a["md"] != "") & (a["md"] == b["md"])
    if strict:
        day = day & ((a["ymd"] == "") | (b["ymd"] == ""))
    return F.when(full | day | ((a["digits"] != "") & (a["digits"] == b["digits"])), F.lit(1.0)).otherwise(F.lit(0.0))


def date_forms(c: Column) -> Column:
    loose = N.loose_date(c)
    return F.struct(loose["ymd"].alias("ymd"), loose["md"].alias("md"), N.date_digits(c).alias("digits"))


def gender_score(a: Column, b: Column) -> Column:
    x, y = N.gender(a), N.gender(b)
    return F.when((x != "") & (x == y), F.lit(1.0)).otherwise(F.lit(0.0))
