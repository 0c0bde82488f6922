"""Gate, registration stub, single and batch submission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import FIELDS
from . import extract, verify

GATE = 0.8


def passes(overall: Column, scores: Column, threshold: float) -> Column:
    """Confidence of threshold or more; without one, the least field score; without any score, yes."""
    return F.coalesce(F.coalesce(overall, F.array_min(scores)) >= threshold, F.lit(True))


def registration_id(key: Column) -> Column:
    """Stub: the same id for the same document."""
    return F.concat(F.lit("PRE"), F.upper(F.substring(F.sha2(key.cast("string"), 256), 1, 10)))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def status_of(registration: Column) -> Column:
    return F.when(registration.isNotNull(), F.lit("pending"))


def integrate(docs: DataFrame, forms: DataFrame, threshold: float = GATE, key: str = "application_id") -> DataFrame:
    """Extract, verify against the form if fields overlap, gate, register what passes. forms has any form keys as columns."""
    got = extract.extract_fields(docs, kind=None)
    pairs = verify.pair(got, forms, key)
    # only what both sides hold is compared; what the document holds and the form doesn't still calls for a comparison
    seen = F.lit(False)
    for f in FIELDS:
        if f in forms.columns:
            seen = seen | (F.coalesce(verify.doc(f), F.lit("")) != "")
    pairs = pairs.withColumn("compared", seen)
    done, compared = verify.verify(pairs), F.col("compared")
    rows = done.withColumns(
        {
            "overall_confidence": F.when(compared, F.col("overall_confidence")),
            "decision": F.when(compared, F.col("decision")),
            "fields": F.when(compared, F.col("fields")),
            "notes": F.when(compared, F.col("notes")).otherwise(F.array(F.lit("no_overlap_fields"))),
        }
    )
    gate = passes(F.col("overall_confidence"), F.array(*[F.col("fields")[f] for f in verify.SCORED]), threshold)
    return rows.withColumn("status", F.when(gate, "success").otherwise("verification_failed")).withColumn(
        "registration_id", F.when(F.col("status") == "success", registration_id(F.col(key)))
    )


def verify_and_submit(pairs: DataFrame, key: str = "application_id") -> DataFrame:
    """Verification and registration of given records, without extraction or gate."""
    return verify.verify(pairs).withColumn("registration_id", registration_id(F.col(key))).withColumn("status", F.lit("success"))


def positional_pairs(files: DataFrame, forms: DataFrame) -> DataFrame:
    """The i-th file of a batch with its i-th form, null where the forms run out: (batch_id, pos) on both sides."""
    return files.join(forms, ["batch_id", "pos"], "left")


def batch_rows(files: DataFrame, forms: DataFrame) -> DataFrame:
    """A row a file (batch_id, pos, file, extracted_data, error): status, id of what could be read, and its form."""
    rows = positional_pairs(files, forms).withColumn("status", F.when(F.col("error").isNull(), "success").otherwise("error"))
    ok = F.col("status") == "success"
    return rows.withColumn("registration_id", F.when(ok, registration_id(F.concat_ws("/", "batch_id", "pos")))).withColumn("upload", F.when(ok, base_name(F.col("file"))))


def batch_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("batch_id").agg(
        F.count("*").alias("total_files"), F.count_if(F.col("status") == "success").alias("successful"), F.count_if(F.col("status") == "error").alias("failed")
    )
