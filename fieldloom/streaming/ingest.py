"""The batch plans over streams.

Against a static table of forms every step is a projection or a join with that side, so there is no state. Where forms stream
in, too, either side may come first: each waits in state for the other, up to a bound of event time, then goes out alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import extract_fields, with_report
from ..operators.verify import decided, map_and_verify, sides
from ..sources.sinks import audit_rows

SCHEMA = "application_id long, raw_text string, document_type string"


def text_stream(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)


def extracted(stream: DataFrame) -> DataFrame:
    return extract_fields(stream)


def start_verification(stream: DataFrame, forms: DataFrame, out: str, checkpoint: str, as_of=None, at: Column | None = None) -> StreamingQuery:
    """Verify documents as they come against a static table of forms; append audit rows as JSON lines, exactly once.

    at is the stamp of the rows; without it, the time of their batch.
    """
    verified = map_and_verify(stream, forms, as_of=as_of)
    rows = audit_rows(verified, at)
    return rows.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def late_pairs(docs: DataFrame, forms: DataFrame, apart: str = "1 day", late: str = "2 days", key: str = "application_id", doc_id: str = "doc_id") -> DataFrame:
    """Documents (key, doc_id, raw_text, document_type, arrived) with the form (key, fields, arrived) that comes within `apart` of them, before or after.

    Rows that are repeated within `late` count once: documents by key and doc_id, forms by key. A document without a form goes
    out with empty form_* columns once the watermark, `late` behind the slower stream, has passed its last chance; a form without
    a document is forgotten then. Rows later than the watermark are dropped. State is bounded by what arrives in apart + late.
    """
    got = with_report(extract_fields(docs.withWatermark("arrived", late).dropDuplicatesWithinWatermark([key, doc_id])))
    once = forms.withWatermark("arrived", late).dropDuplicatesWithinWatermark([key])
    left, right = sides(got, once, key, "arrived")
    right = right.withColumnsRenamed({key: "form_key", "arrived": "form_arrived"})
    near = (F.col(key) == F.col("form_key")) & (F.col("form_arrived") >= F.col("arrived") - F.expr(f"interval {apart}")) & (F.col("form_arrived") <= F.col("arrived") + F.expr(f"interval {apart}"))
    return left.join(right, near, "left_outer").drop("form_key")


def start_late_verification(docs: DataFrame, forms: DataFrame, out: str, checkpoint: str, as_of: Column | None = None, at: Column | None = None, **bounds: str) -> StreamingQuery:
    """Verify documents with forms that stream in, too; audit rows as JSON lines, exactly once."""
    rows = audit_rows(decided(late_pairs(docs, forms, **bounds), as_of), at)
    return rows.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
