"""What the review screen shows and sends, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pytext import blank_to_null, matched, once, squeeze, strip

# Documents asked for by slot.
SLOTS = {"name": "aadhar", "address": "dl", "dob": "birth", "handwritten": "handwritten"}
LOW = 0.6


def form_name(edited: Column, first: Column, middle: Column, last: Column) -> Column:
    return F.coalesce(blank_to_null(edited), squeeze(F.concat_ws(" ", blank_to_null(first), blank_to_null(middle), blank_to_null(last))))


def slot_document(slot: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in SLOTS.items():
        out = out.when(slot == k, F.lit(v))
    return out


def address_line(address: Column, city: Column, state: Column, pincode: Column, raw: Column) -> Column:
    """The parts with commas; a part that is missing is looked for in the raw text."""

    def part(value: Column, label: str, kind: str) -> Column:
        return F.coalesce(blank_to_null(value), blank_to_null(strip(matched(raw, rf"(?iU){label}\s*[:\-]?\s*({kind})"))))

    return F.concat_ws(", ", part(address, "address", r"[^\n]+"), part(city, "city", r"[^\n]+"), part(state, "state", r"[^\n]+"), part(pincode, r"pin\s*code", r"\d{4,8}"))


def any_dob(record: Column) -> Column:
    """First non-empty of the keys that hold a date of birth, in a map."""
    return F.coalesce(*[blank_to_null(F.try_element_at(record, F.lit(k))) for k in ("dob", "date_of_birth", "birth_date", "DOB")])


def merged_keys(record: Column) -> Column:
    """Map with keys in lower case; of equal keys the first non-empty value."""
    lowered = F.transform(F.map_entries(record), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))

    def merged(entries: Column) -> Column:
        keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
        first = F.transform(
            keys,
            lambda k: F.struct(k.alias("key"), F.get(F.transform(F.filter(entries, lambda e: (e["key"] == k) & (F.coalesce(e["value"], F.lit("")) != "")), lambda e: e["value"]), F.lit(0)).alias("value")),
        )
        return F.map_from_entries(first)

    return once(lowered, merged)


# Document slots, and fields of a handwritten form, in the order of display, with their labels.
SLOT_LABELS = {"name": "Aadhaar/Voter ID (Name)", "address": "DL/Passport (Address)", "dob": "Birth/SLC (DOB)", "handwritten": "Handwritten (All Fields)"}
FIELD_LABELS = {
    "name": "Name", "dob": "Date of Birth", "gender": "Gender", "address": "Address", "city": "City", "state": "State", "pincode": "Pincode", "phone": "Phone", "email": "Email",
}


def shown_slots(rows: DataFrame, slot: str = "slot") -> DataFrame:
    """rows of the slots that are shown, with their place (from 1) and label; order by place to display."""
    place = F.array_position(F.array(*[F.lit(k) for k in SLOT_LABELS]), F.col(slot))
    label = F.get(F.array(*[F.lit(v) for v in SLOT_LABELS.values()]), (place - 1).cast("int"))
    return rows.withColumns({"place": place, "label": label}).where("place > 0")


def labelled_lines(record: Column) -> Column:
    """"Label: value" lines of a map: known fields in their order, then the others in the map's; blank values have no line."""
    whole = merged_keys(F.transform_values(record, lambda k, v: F.when(k == "email", plain_email(strip(v))).otherwise(strip(v))))

    def lines(merged: Column) -> Column:
        def line(key: Column, label: Column) -> Column:
            return once(F.try_element_at(merged, key), lambda value: F.when(value != "", F.concat(label, F.lit(": "), value)))

        known = [line(F.lit(k), F.lit(v)) for k, v in FIELD_LABELS.items()]
        others = F.filter(F.map_keys(merged), lambda k: ~k.isin(list(FIELD_LABELS)))
        return F.array_compact(F.concat(F.array(*known), F.transform(others, lambda k: line(k, k))))

    return once(whole, lines)


def plain_email(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)^id:\s*", "")


def month_first(c: Column) -> Column:
    """Date of year-month-day, or of month/day/year with the two swapped if there is no such month."""
    s = F.translate(strip(c), "/.", "--")
    ymd, mdy = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})-(\d{1,2})-(\d{4})$"
    a, b = F.regexp_extract(s, mdy, 1).try_cast("int"), F.regexp_extract(s, mdy, 2).try_cast("int")
    month, day = F.when(a > 12, b).otherwise(a), F.when(a > 12, a).otherwise(b)
    iso = F.when(F.regexp_like(s, F.lit(ymd)), s).when(F.regexp_like(s, F.lit(mdy)), F.format_string("%s-%d-%d", F.regexp_extract(s, mdy, 3), month, day))
    return F.try_to_date(iso, "yyyy-M-d")


def edited_dob_confidence(before: Column, after: Column) -> Column:
    a, b = month_first(before), month_first(after)
    return F.when(a.isNull() | b.isNull(), 0.6).when(a == b, 1.0).otherwise(0.55)


def percent(score: Column) -> Column:
    return F.round(score * 100).cast("int")


def average_confidence(rows: DataFrame, key: str) -> DataFrame:
    """Mean confidence by key; a missing one counts 1, no rows count 0."""
    return rows.groupBy(key).agg(F.coalesce(F.avg(F.coalesce("confidence", F.lit(1.0))), F.lit(0.0)).alias("average_confidence"))


def reviewed_again(before: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Rows of before with those of changed in their place."""
    return before.join(changed.select(key), key, "left_anti").unionByName(changed)


def status_class(status: Column) -> Column:
    s = F.lower(status)

    def has(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(s, F.lit(w))
        return out

    return F.when(has("approved", "success"), "success").when(has("rejected", "failed"), "danger").when(has("pending", "processing"), "warning").otherwise("secondary")


def primary_document(identity: Column, address: Column, birth: Column) -> Column:
    return F.coalesce(blank_to_null(identity), blank_to_null(address), blank_to_null(birth))


def given_if(has_document: Column, value: Column) -> Column:
    return F.when(has_document, value)


def form_problems() -> Column:
    """Names of form columns that are missing or malformed."""
    checks = {
        "first_name": F.coalesce(strip(F.col("first_name")), F.lit("")) != "",
        "last_name": F.coalesce(strip(F.col("last_name")), F.lit("")) != "",
        "dob": F.try_to_date("dob", "yyyy-MM-dd").isNotNull(),
        "gender": F.coalesce(F.col("gender").isin("Male", "Female", "Other"), F.lit(False)),
        "email": F.coalesce(F.regexp_like("email", F.lit(r"^[^@\s]+@[^@\s]+$")), F.lit(False)),
        "phone": F.coalesce(F.col("phone"), F.lit("")) != "",
        "address": F.coalesce(strip(F.col("address")), F.lit("")) != "",
    }
    return F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())


def last_registration(rows: DataFrame, key: str, at: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by("registration_id", at).alias("registration_id"))


def forms_for_files(files: DataFrame, form: DataFrame) -> DataFrame:
    """The one form of a batch repeated for each of its files: form has one row a batch_id."""
    return files.join(form, "batch_id")


def shown_value(value: Column, plain: Column) -> Column:
    return F.coalesce(value, plain)


def first_by_priority(rows: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """Long form of first match wins: the row of least rank for each key."""
    return rows.withColumn("at", F.row_number().over(W.partitionBy(*keys).orderBy(rank))).where("at = 1").drop("at")
