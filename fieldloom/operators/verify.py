"""Pairs of document and form records to a confidence, a decision, field scores and notes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..functions.dictionaries import DOCUMENT_FIELDS, FIELDS, KEY_NAMES, SCORED, WEIGHTS
from ..functions.pytext import present
from . import extract
from . import score as C

MATCH, REVIEW = 0.85, 0.6
VERSION = "a3-v1"
SKIPPED = "verification_skipped_no_overlap"


def doc(field: str) -> Column:
    return F.col(f"doc_{field}")


def form(field: str) -> Column:
    return F.col(f"form_{field}")


def both(field: str) -> Column:
    return present(doc(field)) & present(form(field))


def decision(confidence: Column) -> Column:
    return F.when(confidence >= MATCH, "MATCH").when(confidence >= REVIEW, "REVIEW").otherwise("MISMATCH")


def checked_weights(weights: dict[str, float] | None) -> dict[str, float]:
    """The default weights for None and {}; unknown keys are an error of the plan, not of a row."""
    unknown = set(weights or {}) - set(SCORED)
    if unknown:
        raise ValueError(f"no score for {sorted(unknown)}")
    return weights or WEIGHTS


def confidence(scores: dict[str, Column], available: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the scores of available fields; 0 if there are none."""
    zero = F.lit(0.0)
    total = sum((F.when(available[f], F.lit(float(w))).otherwise(zero) for f, w in weights.items()), zero)
    total = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return sum((F.when(available[f], F.lit(float(w)) / total * scores[f]).otherwise(zero) for f, w in weights.items()), zero)


def low_notes(scores: dict[str, Column], available: dict[str, Column], weights: dict[str, float]) -> Column:
    notes = [F.when(available[f] & (scores[f] < REVIEW), F.format_string(f"{f} low_score(%.2f)", F.bround(scores[f], 2))) for f in weights]
    return F.filter(F.array(*notes), lambda n: n.isNotNull())


def scored(pairs: DataFrame, strict_dob: bool = False) -> DataFrame:
    """Adds s_<field> for each scored field of doc_* and form_* columns.

    Both sides' normal forms are computed once; the fuzzy ratios run on them in one Arrow exchange.
    """
    cast = pairs.select("*", *[F.coalesce(F.col(f"{side}_{f}").cast("string"), F.lit("")).alias(f"t_{side}_{f}") for side in ("doc", "form") for f in SCORED])
    latin = cast.select("*", *[N.to_latin(f"t_{side}_{f}").alias(f"n_{side}_{f}") for side in ("doc", "form") for f in ("name", "address", "phone")])
    normal = latin.select(
        *[c for c in latin.columns if not c.startswith("n_")],
        *[N.generic(F.col(f"n_{side}_{f}")).alias(f"n_{side}_{f}") for side in ("doc", "form") for f in ("name", "address")],
        *[N.digits(F.col(f"n_{side}_phone")).alias(f"n_{side}_phone") for side in ("doc", "form")],
        *[C.date_forms(F.col(f"t_{side}_dob")).alias(f"n_{side}_dob") for side in ("doc", "form")],
    )
    fuzzy = normal.select("*", C.name_ratio("n_doc_name", "n_form_name").alias("f_name"), C.address_ratio("n_doc_address", "n_form_address").alias("f_address"))
    return fuzzy.select(
        *pairs.columns,
        C.name_score(F.col("n_doc_name"), F.col("n_form_name"), F.col("f_name")).alias("s_name"),
        C.dob_score(F.col("n_doc_dob"), F.col("n_form_dob"), strict_dob).alias("s_dob"),
        C.phone_score(F.col("n_doc_phone"), F.col("n_form_phone")).alias("s_phone"),
        C.address_score(F.col("n_doc_address"), F.col("n_form_address"), F.col("f_address")).alias("s_address"),
        C.gender_score(F.col("t_doc_gender"), F.col("t_form_gender")).alias("s_gender"),
    )


def verify(pairs: DataFrame, weights: dict[str, float] | None = None, as_of: Column | None = None, strict_dob: bool = False) -> DataFrame:
    """Adds overall_confidence, decision, fields, notes and version to pairs of doc_* and form_* columns.

    as_of: the day that ages are counted to; no age note without it.
    """
    weights = checked_weights(weights)
    rows = scored(pairs, strict_dob)
    scores, available = {f: F.col(f"s_{f}") for f in SCORED}, {f: both(f) for f in SCORED}
    notes = low_notes(scores, available, weights)
    if as_of is not None:
        notes = F.array_compact(F.concat(notes, F.array(N.age_note(doc("dob"), doc("age"), as_of))))
    rows = rows.withColumn("raw_confidence", confidence(scores, available, weights))
    return rows.select(
        *pairs.columns,
        F.round("raw_confidence", 4).alias("overall_confidence"),
        decision(F.col("raw_confidence")).alias("decision"),
        F.struct(*[F.round(scores[f], 4).alias(f) for f in SCORED]).alias("fields"),
        notes.alias("notes"),
        F.lit(VERSION).alias("version"),
    )


def canonical_keys(record: Column, lower: bool = False) -> Column:
    """map<string,string> with keys in lower case if asked, other names of a field renamed; of equal keys the last wins."""
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(KEY_NAMES.items())])
    entries = F.transform(F.map_entries(record), lambda e: F.struct((F.lower(e["key"]) if lower else e["key"]).alias("key"), e["value"].alias("value")))
    entries = F.transform(entries, lambda e: F.struct(F.coalesce(F.try_element_at(names, e["key"]), e["key"]).alias("key"), e["value"].alias("value")))
    last = F.aggregate(
        entries,
        F.filter(entries, lambda e: F.lit(False)),
        lambda acc, e: F.concat(F.filter(acc, lambda x: x["key"] != e["key"]), F.array(e)),
    )
    return F.map_from_entries(last)


def sides(docs: DataFrame, forms: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Records and forms with every field, as doc_* and form_*; forms keep nothing but those and their keys."""
    left = docs.select(*[c for c in docs.columns if c not in FIELDS], *[F.col(f).alias(f"doc_{f}") for f in FIELDS if f in docs.columns])
    right = forms.select(*keys, *[F.col(c).cast("string").alias(f"form_{c}") for c in forms.columns if c in FIELDS])
    for f in FIELDS:
        if f"doc_{f}" not in left.columns:
            left = left.withColumn(f"doc_{f}", F.lit(None).cast("string"))
        if f"form_{f}" not in right.columns:
            right = right.withColumn(f"form_{f}", F.lit(None).cast("string"))
    return left, right


def pair(docs: DataFrame, forms: DataFrame, key: str = "application_id") -> DataFrame:
    """Join records with forms by key: fields as doc_* and form_*. Spark broadcasts the forms if they are small."""
    left, right = sides(docs, forms, key)
    return left.join(right, key)


def restrict(pairs: DataFrame, kind: str = "document_type") -> DataFrame:
    """Null out fields that a kind of document doesn't vouch for; forms of other kinds keep the scored fields."""
    of = F.lower(F.coalesce(F.col(kind), F.lit("")))
    known = of.isin(list(DOCUMENT_FIELDS))
    out = {}
    for f in FIELDS:
        kinds = [k for k, fs in DOCUMENT_FIELDS.items() if f in fs]
        vouched = of.isin(kinds) if kinds else F.lit(False)
        out[f"doc_{f}"] = F.when(~known | vouched, doc(f))
        out[f"form_{f}"] = F.when(vouched | (~known & F.lit(f in SCORED)), form(f))
    return pairs.withColumns(out)


def overlap(names: list[str]) -> Column:
    """Whether any of the fields is non-empty on both sides."""
    any_of = F.lit(False)
    for f in names:
        any_of = any_of | both(f)
    return any_of


def map_and_verify(docs: DataFrame, forms: DataFrame, as_of: Column | None = None, key: str = "application_id") -> DataFrame:
    """docs (key, raw_text, document_type) and forms (key, fields): extraction, completeness, restriction, verification."""
    return decided(pair(extract.with_report(extract.extract_fields(docs)), forms, key), as_of)


def decided(pairs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Restriction and verification of pairs; those that share no field are left to a reviewer."""
    pairs = restrict(pairs).withColumn("compared", overlap(FIELDS))
    done = verify(pairs, as_of=as_of)
    kept, compared = F.col("notes"), F.col("compared")
    # notes of pairs that aren't compared are about age alone: no field is on both sides
    return done.withColumns(
        {
            "overall_confidence": F.when(compared, F.col("overall_confidence")).otherwise(0.75),
            "decision": F.when(compared, F.col("decision")).otherwise("REVIEW"),
            "fields": F.when(compared, F.col("fields")),
            "notes": F.when(compared, kept).otherwise(F.concat(F.array(F.lit(SKIPPED)), kept)),
        }
    )
