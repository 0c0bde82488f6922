"""Audit logs and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import SCORED

_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def utc_stamp(at: Column | None = None) -> Column:
    """ISO time in UTC, whatever the session's time zone."""
    at = F.current_timestamp() if at is None else at
    return F.date_format(F.convert_timezone(None, F.lit("UTC"), at.cast("timestamp_ntz")), _STAMP)


def audit_rows(verified: DataFrame, at: Column | None = None) -> DataFrame:
    """(ts, ocr, user, response) of verified pairs."""
    sides = [F.struct(*[F.col(f"{side}_{f}").alias(f) for f in SCORED]).alias(name) for side, name in (("doc", "ocr"), ("form", "user"))]
    return verified.select(utc_stamp(at).alias("ts"), *sides, F.struct("overall_confidence", "decision", "fields", "notes", "version").alias("response"))


def append_jsonl(verified: DataFrame, path: str, at: Column | None = None) -> None:
    audit_rows(verified, at).write.mode("append").json(path)


def flat_rows(verified: DataFrame) -> DataFrame:
    """overall_confidence, decision, f_*, ocr_*, user_*: one column each."""
    return verified.select(
        "overall_confidence",
        "decision",
        *[F.col("fields")[f].alias(f"f_{f}") for f in SCORED],
        *[F.col(f"doc_{f}").alias(f"ocr_{f}") for f in SCORED],
        *[F.col(f"form_{f}").alias(f"user_{f}") for f in SCORED],
    )


def append_csv(verified: DataFrame, path: str) -> None:
    """Each part file has a header of its own."""
    flat_rows(verified).write.mode("append").option("header", "true").csv(path)


def export_json(rows: DataFrame, **parts: Column) -> DataFrame:
    """One JSON text a row of the named parts, for write.text."""
    return rows.select(F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()])).alias("value"))
