"""Registered queries, one or more for each operator of the survey, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions import dictionaries as D
from ..functions import fuzzy, latin, pytext
from ..functions import normalise as N
from ..operators import extract, link, ocrlines, register, review, verify
from ..operators import score as C
from ..sources import documents as sources
from ..sources import images, sinks
from . import expected as X
from . import inputs as I

QUERIES: dict = {}
ORACLES: dict = {}
AS_OF = "2026-01-01"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sql_map(table: dict, key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} = '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {key} END"


def _sql_case(table: dict, key: str) -> str:
    """CASE key WHEN ..., for use inside a lambda."""
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {key} END"


_ASCII = {k: v for k, v in D.EXPANSIONS.items() if k.isascii()}
_STOP = "[" + ", ".join(f"'{w}'" for w in D.STOP_TOKENS if w.isascii()) + "]"


def _sql_expand(c: str) -> str:
    tokens = f"list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: w <> '')"
    bare = f"list_transform({tokens}, lambda w: regexp_replace(w, '^(\\w+)[^\\w]*$', '\\1'))"
    return f"array_to_string(list_transform({bare}, lambda v: {_sql_case(_ASCII, 'v')}), ' ')"


def _sql_stop(c: str) -> str:
    return f"array_to_string(list_filter(regexp_split_to_array({c}, '\\s+'), lambda t: t <> '' AND NOT list_contains({_STOP}, t)), ' ')"


def _sql_generic(c: str) -> str:
    return _sql_stop(_sql_expand(f"trim(regexp_replace(regexp_replace(lower({c}), '[.,;:!?\\-()\"''/]', ' ', 'g'), '\\s+', ' ', 'g'))"))


_PHONE = """CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b OR right(a, 10) = right(b, 10) THEN 1.0 WHEN length(a) >= 9 AND length(b) >= 9 AND right(a, 9) = right(b, 9) THEN 0.95
  WHEN length(a) >= 8 AND length(b) >= 8 AND right(a, 8) = right(b, 8) THEN 0.9 WHEN length(a) >= 7 AND length(b) >= 7 AND right(a, 7) = right(b, 7) THEN 0.85
  WHEN length(a) >= 6 AND length(b) >= 6 AND right(a, 6) = right(b, 6) THEN 0.8
  ELSE greatest(0.0, 1 - CAST(list_sum(list_transform(range(1, 11), lambda i: CASE WHEN substr(lpad(right(a, 10), 10, '0'), CAST(i AS INTEGER), 1) <> substr(lpad(right(b, 10), 10, '0'), CAST(i AS INTEGER), 1) THEN 1 ELSE 0 END)) + 10 - least(length(b), 10) AS DOUBLE) / 10) END"""


# Sources, sinks


@query("SELECT doc_id, CASE WHEN ext = '.pdf' THEN 'pdf' ELSE 'image' END AS file_type, CASE WHEN ext IN ('.jpg', '.jpeg', '.png', '.bmp', '.tiff', '.webp') THEN 'image' WHEN ext = '.pdf' THEN 'pdf' END AS handler FROM (SELECT doc_id, ['.jpg', '.pdf', '.tiff', '.docx'][doc_id % 4 + 1] AS ext FROM documents)")
def s1_file_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in (".JPG", ".pdf", ".Tiff", ".docx")]), F.expr("cast(doc_id % 4 + 1 as int)"))
    path = F.concat(F.lit("/scans/v1.2/doc-"), F.col("doc_id").cast("string"), ext)
    return I.table(spark, sf_dir, "documents").select("doc_id", sources.file_type(path).alias("file_type"), sources.handler(path).alias("handler"))


@query("SELECT conv_id, string_agg('--- PAGE ' || turn || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn, text) AS raw_text FROM conversations GROUP BY conv_id")
def s3_page_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = I.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page_no"), "text")
    return sources.assemble_pages(pages, "conv_id")


@query(I.SQL + "SELECT CAST(application_id AS VARCHAR) AS path, '--- PAGE 1 ---' || chr(10) || raw_text AS raw_text, CAST(NULL AS VARCHAR) AS error FROM docs")
def s6_recognise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recogniser is a stand-in that reads lines out of bytes; what is run is the rest of the path."""
    return sources.extract_text(_scans(spark, sf_dir), _line_reader)


def _line_reader(lang: str):
    return lambda content, how: [content.decode().split("\n")]


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.documents(spark, sf_dir).select(F.col("application_id").cast("string").alias("path"), F.encode("raw_text", "UTF-8").alias("content"), F.lit("pdf").alias("handler"))


@query("WITH d AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events) SELECT event_id, k FROM d")
def s8_json_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "events").select("event_id", sources.read_forms(F.col("props"))["k"].alias("k"))


def _bitmap(values: pd.Series) -> pd.Series:
    """A vector as a square grey PNG, a pixel an entry, magnified four times."""
    out = []
    for v in values:
        x = np.floor(np.clip(np.asarray(v, float), -1, 1) * 127.5 + 127.5).astype(np.uint8)
        x = np.kron(x.reshape(8, -1), np.ones((4, 4), np.uint8))
        parts = [(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in x), 1)), (b"IEND", b"")]
        out.append(b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)) for kind, body in parts))
    return pd.Series(out)


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, content): every seventh file is cut off."""
    rows = I.table(spark, sf_dir, "embeddings").repartition(spark.sparkContext.defaultParallelism, "vec_id")
    content = F.pandas_udf(_bitmap, "binary")("embedding")
    return rows.select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.substring(content, 1, 60)).otherwise(content).alias("content"))


@F.pandas_udf(StructType([StructField("height", IntegerType()), StructField("width", IntegerType()), StructField("total", LongType())]))
def _summed(pictures: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pictures' sizes and sums, in the worker that decodes them: pixels never leave it."""
    for x in pictures:
        total = x["pixels"].map(lambda p: None if p is None else int(np.frombuffer(p, np.uint8).sum())).astype("Int64")
        yield x[["height", "width"]].assign(total=total)


@query("""SELECT vec_id, CASE WHEN vec_id % 7 > 0 THEN 32 END AS height, CASE WHEN vec_id % 7 > 0 THEN CAST(len(embedding) / 2 AS INTEGER) END AS width,
  CASE WHEN vec_id % 7 > 0 THEN CAST(48 * list_sum(list_transform(embedding, lambda x: floor(greatest(-1, least(1, CAST(x AS DOUBLE))) * 127.5 + 127.5))) AS BIGINT) END AS total FROM embeddings""")
def s2_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and sum of all channels of decoded pictures; nulls of those that are broken."""
    rows = _pictures(spark, sf_dir).select("vec_id", _summed(images.decoded("content")).alias("image"))
    return rows.select("vec_id", "image.*")


@query()
def s4_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures as they go to a recogniser: denoised, with local contrast, scaled up, sharpened."""
    rows = _pictures(spark, sf_dir).select("vec_id", images.prepared("content").alias("image"))
    return rows.select("vec_id", "image.height", "image.width", F.crc32("image.pixels").alias("pixels_crc32"))


@query("SELECT doc_id, ['pdf', 'image', 'image', 'image', 'image', 'image', 'pdf'][doc_id % 7 + 1] AS kind FROM documents")
def s1_content_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = ["255044462D", "89504E470D0A1A0A", "FFD8FFE0", "424D0000", "49492A0008", "524946460000000057454250", ""]
    head = F.element_at(F.array(*[F.lit(h) for h in heads]), F.expr("cast(doc_id % 7 + 1 as int)"))
    return I.table(spark, sf_dir, "documents").select("doc_id", sources.content_kind(F.concat(F.unhex(head), F.encode("text", "UTF-8"))).alias("kind"))


_SIDES = "p.first || ' ' || p.last AS ocr_name, strftime(p.born, '%-d %b %Y') AS ocr_dob, '+91 ' || p.phone AS ocr_phone, p.house || ' ' || p.road AS ocr_address, p.sex AS ocr_gender, " + ", ".join(f"f.{x} AS user_{x}" for x in D.SCORED)
_FLOW = I.SQL + ", " + X.verified(X.PEOPLE, _sql_generic, _PHONE)
_SCORES = ", ".join(f"f_{f}" for f in D.SCORED)
_FROM_PAIRS = "FROM done JOIN people p ON p.application_id = done.application_id JOIN forms f ON f.application_id = done.application_id"


@query(f"{_FLOW} SELECT '2026-01-01T00:00:00.000000' AS ts, {_SIDES}, overall_confidence, decision, {_SCORES}, notes, 'a3-v1' AS version {_FROM_PAIRS}")
def s9_audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.audit_rows(e6_verify_pairs(spark, sf_dir), F.lit("2026-01-01 00:00:00").cast("timestamp"))
    sides = [F.col(side)[f].alias(f"{side}_{f}") for side in ("ocr", "user") for f in D.SCORED]
    scores = [F.col("response.fields")[f].alias(f"f_{f}") for f in D.SCORED]
    return rows.select("ts", *sides, "response.overall_confidence", "response.decision", *scores, "response.notes", "response.version")


@query(f"{_FLOW} SELECT overall_confidence, decision, {_SCORES}, {_SIDES} {_FROM_PAIRS}")
def s10_flat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.flat_rows(e6_verify_pairs(spark, sf_dir))


@query(I.SQL + "SELECT '{\"user\":{\"name\":\"' || name || '\",\"dob\":\"' || dob || '\"},\"timestamp\":\"x\"}' AS value FROM forms")
def s11_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.export_json(I.forms(spark, sf_dir), user=F.struct("name", "dob"), timestamp=F.lit("x"))


@query("SELECT c_custkey, 'PRE' || upper(left(sha256(CAST(c_custkey AS VARCHAR)), 10)) AS registration_id, 'doc.pdf' AS file, 'pending' AS status FROM customer")
def s13_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "customer").select("c_custkey", register.registration_id(F.col("c_custkey")).alias("registration_id"), register.base_name(F.lit("/tmp/up/doc.pdf")).alias("file"))
    return rows.withColumn("status", register.status_of(F.col("registration_id")))


# Lines


@query(
    I.SQL
    + """SELECT application_id, ['First Name: ' || first, 'Last Name: ' || last, 'DOB', strftime(born, '%d/%m/%Y'), 'Gender: ' || sex, 'Address: ' || house || ' ' || road, 'City', city || '.',
    'State', state || '.', 'Pin Code', pin, 'Phone', '+91 ' || phone, 'Email', upper(mail)] AS lines FROM people"""
)
def x_line_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.documents(spark, sf_dir)
    return docs.select("application_id", ocrlines.normalise_lines(F.split(F.regexp_replace("raw_text", ": ", "\n"), "\n")).alias("lines"))


def _noisy_lines(k):
    """Labels with slips, values on the same line or the next, repeats, and lines that go."""
    n = k.cast("string")
    return F.array(
        F.lit("Frst Name"), F.concat(F.lit("Abc"), n), F.lit("surname： Xyz"), F.lit("Sex"), F.when(k % 2 == 0, "m").otherwise("F"), F.lit("my age is this"), F.concat((k % 90 + 10).cast("string"), F.lit(" years")),
        F.concat(F.lit("row "), n), F.concat(F.lit("row "), n), F.lit("ab"), F.lit("पंक्ति"), F.lit(None).cast("string"), F.lit("  "), F.concat(F.lit("Permanent Address — "), n, F.lit(" MG Road")), F.lit("Gender"), F.lit("Last Name"), F.lit("Pqr"),
    )


@query(
    "SELECT c_custkey, ['First Name: Abc' || c_custkey, 'Last Name: Xyz', 'Gender: ' || CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END, 'Age: ' || (c_custkey % 90 + 10), 'row ' || c_custkey, "
    "'Address: ' || c_custkey || ' MG Road', 'Gender', 'Last Name: Pqr'] AS lines FROM customer"
)
def x_noisy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.spread(spark, sf_dir, "customer", "c_custkey").select("c_custkey", ocrlines.normalise_lines(_noisy_lines(F.col("c_custkey"))).alias("lines"))


_LINES = "SELECT doc_id, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda m: regexp_matches(m, '[A-Za-z0-9]') AND length(m) >= 3)) AS kept FROM documents"


@query(f"SELECT doc_id, list_sort(kept) AS lines FROM ({_LINES})")
def x8_kept_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "documents").select("doc_id", F.array_sort(ocrlines.normalise_lines(F.split("text", "\n"))).alias("lines"))


@query(f"SELECT doc_id, CAST(len(kept) AS BIGINT) AS n_lines FROM ({_LINES})")
def x9_distinct_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = F.split(F.concat("text", F.lit("\n"), "text"), "\n")
    return I.table(spark, sf_dir, "documents").select("doc_id", F.size(ocrlines.normalise_lines(twice)).cast("long").alias("n_lines"))


# Extraction


@query(
    I.SQL
    + r"""SELECT application_id, nullif(regexp_extract(raw_text, '(?i)\bFirst Name[:\s]*([A-Za-z]{2,})', 1), '') AS first_name,
    nullif(regexp_extract(raw_text, '(?i)\bMiddle Name[:\s]*([A-Za-z]{2,})', 1), '') AS middle_name,
    nullif(regexp_extract(raw_text, '(?i)\bDOB[:\s]*([0-9]{1,2}[\-/][0-9]{1,2}[\-/][0-9]{2,4})', 1), '') AS dob,
    nullif(regexp_extract(raw_text, '(?i)\bGender[:\s]*([A-Za-z]{4,8})', 1), '') AS gender,
    nullif(regexp_extract(raw_text, '(?i)\bPin\s*Code[:\s]*(\d{4,8})', 1), '') AS pincode FROM docs"""
)
def m2_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.documents(spark, sf_dir).select("application_id", extract.found_values("raw_text").alias("found"))
    return rows.select("application_id", *[F.col("found")[f"p_{f}"].alias(f) for f in ("first_name", "middle_name", "dob", "gender", "pincode")])


@query(I.MIXED_SQL + "SELECT application_id, kind, " + ", ".join(f"m_{f} AS {f}" for f in I.PARTS) + " FROM m")
def m1_all_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thirteen patterns over forms in two languages, badly read ones, and pages without any."""
    rows = I.mixed_documents(spark, sf_dir).select("application_id", "kind", extract.found_values("raw_text").alias("found"))
    return rows.select("application_id", "kind", *[F.col("found")[f"p_{f}"].alias(f) for f in I.PARTS])


@query(
    I.MIXED_SQL
    + """SELECT application_id, kind, CASE WHEN kind = 'short' THEN first || ' ' || last ELSE m_first_name || ' ' || m_middle_name || ' ' || m_last_name END AS name, m_gender AS gender, m_dob AS dob, m_age AS age,
    CASE WHEN kind = 'short' THEN m_city || ' ' || m_state || ' ' || m_pincode ELSE m_address_line1 || ' ' || m_address_line2 END AS address, m_city AS city, m_state AS state, m_pincode AS pincode,
    replace(m_phone, ' ', '') AS phone, replace(lower(m_email), 'qmail', 'gmail') AS email,
    CAST(CASE kind WHEN 'bare' THEN 0 WHEN 'short' THEN 5 ELSE 10 END AS BIGINT) AS fields_count,
    CASE kind WHEN 'bare' THEN ['name', 'age', 'gender', 'address', 'phone', 'email'] WHEN 'short' THEN ['age', 'gender', 'phone', 'email'] ELSE CAST([] AS VARCHAR[]) END AS missing_fields FROM m"""
)
def m8_mixed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records of the same: joined name parts and address lines, a name on one line, an address made of its places."""
    rows = extract.with_report(extract.extract_fields(I.mixed_documents(spark, sf_dir)))
    return rows.drop("raw_text").withColumn("fields_count", F.col("fields_count").cast("long"))


_LINE = r"list_extract(list_filter(list_transform(string_split(raw_text, chr(10)), lambda l: nullif(regexp_extract(l, '(?i)^\s*{0}\s*[:\-]?\s*(.+)$', 1), '')), lambda v: v IS NOT NULL), -1) AS {1}"


@query(I.SQL + "SELECT application_id, " + ", ".join(_LINE.format(a, b) for a, b in (("(?:city)", "city"), ("(?:state)", "state"), ("(?:gender|sex)", "gender"), ("(?:date of birth|dob|birth date)", "dob"))) + " FROM docs")
def m3_label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.documents(spark, sf_dir).select("application_id", extract.found_values("raw_text").alias("found"))
    return rows.select("application_id", *[F.col("found")[f"l_{f}"].alias(f) for f in ("city", "state", "gender", "dob")])


@query(I.SQL + "SELECT application_id, first || ' ' || last AS name, house || ' ' || road AS address, city || ' ' || state || ' ' || pin AS place FROM people")
def m4_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.people(spark, sf_dir).select(
        "application_id",
        extract.join_parts(F.col("first"), F.lit("  "), F.col("last")).alias("name"),
        extract.join_parts(F.col("house"), F.col("road")).alias("address"),
        extract.join_parts(F.col("city"), F.lit(None).cast("string"), F.col("state"), F.col("pin")).alias("place"),
    )


@query(I.SQL + "SELECT application_id, first || ' ' || last AS name FROM people WHERE application_id % 6 = 1")
def m7_name_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.documents(spark, sf_dir).where("document_type = 'aadhar'").select("application_id", extract.name_only(F.col("raw_text")).alias("name"))


@query(I.SQL + "SELECT application_id, lower(replace(mail, 'qmail', 'gmail')) AS email, '+91' || phone AS phone, left(pin, 6) AS pincode, first || '-' || last AS titled FROM people")
def m11_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.people(spark, sf_dir).select(
        "application_id",
        extract.clean("email", F.concat(F.lit(" "), F.upper("mail"))).alias("email"),
        extract.clean("phone", F.concat(F.lit("+91 ("), F.left("phone", F.lit(3)), F.lit(") "), F.substring("phone", 4, 10), F.lit(" "))).alias("phone"),
        extract.clean("pincode", F.concat(F.col("pin"), F.lit("-12"))).alias("pincode"),
        extract.clean("last_name", F.lower(F.concat("first", F.lit("-"), "last"))).alias("titled"),
    )


_FULL = """SELECT application_id, document_type, first || ' ' || last AS name, CASE WHEN n THEN NULL ELSE sex END AS gender, CASE WHEN n THEN NULL ELSE strftime(born, '%d/%m/%Y') END AS dob,
  CAST(NULL AS VARCHAR) AS age, CASE WHEN n THEN NULL ELSE house || ' ' || road END AS address, CASE WHEN n THEN NULL ELSE city END AS city, CASE WHEN n THEN NULL ELSE state END AS state,
  CASE WHEN n THEN NULL ELSE pin END AS pincode, CASE WHEN n THEN NULL ELSE '+91' || phone END AS phone, CASE WHEN n THEN NULL ELSE lower(replace(mail, 'qmail', 'gmail')) END AS email"""


_FULL_ROWS = _FULL + ", CAST(CASE WHEN n THEN 1 ELSE 9 END AS BIGINT) AS fields_count, CASE WHEN n THEN ['age', 'gender', 'address', 'phone', 'email'] ELSE ['age'] END AS missing_fields FROM (SELECT p.*, d.document_type, coalesce(d.document_type = 'aadhar', FALSE) AS n FROM people p JOIN docs d USING (application_id))"


@query(I.SQL + _FULL_ROWS)
def e4_extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.with_report(extract.extract_fields(I.documents(spark, sf_dir)))
    return rows.drop("raw_text").withColumn("fields_count", F.col("fields_count").cast("long"))


@query(
    I.SQL
    + """SELECT CAST(application_id AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS error, first || ' ' || last AS name, sex AS gender, strftime(born, '%d/%m/%Y') AS dob, CAST(NULL AS VARCHAR) AS age,
    house || ' ' || road AS address, city, state, pin AS pincode, '+91' || phone AS phone, lower(replace(mail, 'qmail', 'gmail')) AS email, CAST(9 AS BIGINT) AS fields_count, ['age'] AS missing_fields FROM people"""
)
def e2_extract_and_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.extract_and_map(_scans(spark, sf_dir), _line_reader)
    return rows.drop("raw_text").withColumn("fields_count", F.col("fields_count").cast("long"))


# Projections, predicates, pairing


@query(
    I.SQL
    + """SELECT d.application_id, document_type, CASE WHEN document_type IN ('aadhar', 'voter') OR free THEN name END AS form_name, CASE WHEN document_type IN ('birth', 'slc') OR free THEN dob END AS form_dob,
    CASE WHEN document_type IN ('dl', 'passport') OR free THEN address END AS form_address, CASE WHEN free THEN phone END AS form_phone, CAST(NULL AS VARCHAR) AS form_email
    FROM (SELECT *, document_type IS NULL OR document_type = 'handwritten' AS free FROM docs) d JOIN forms f ON d.application_id = f.application_id"""
)
def p1_document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = verify.restrict(verify.pair(I.documents(spark, sf_dir), I.forms(spark, sf_dir)))
    return pairs.select("application_id", "document_type", "form_name", "form_dob", "form_address", "form_phone", "form_email")


@query(I.SQL + "SELECT application_id, application_id % 2 = 0 AND application_id % 3 <> 0 AS compared FROM people")
def p4_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("application_id")
    rows = I.people(spark, sf_dir).select("application_id", F.when(k % 2 == 0, F.col("first")).alias("doc_name"), F.when(k % 3 != 0, F.col("first")).otherwise("").alias("form_name"))
    return rows.select("application_id", verify.overlap(["name"]).alias("compared"))


@query(I.SQL + "SELECT application_id, first AS name, phone, CAST(born AS VARCHAR) AS dob, last AS surname FROM people")
def p6_canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.create_map(F.lit("Full_Name"), F.lit("old"), F.lit("first_name"), F.col("first"), F.lit("MOBILE"), F.col("phone"), F.lit("birth_date"), F.col("born").cast("string"), F.lit("last_name"), F.col("last"))
    rows = I.people(spark, sf_dir).select("application_id", verify.canonical_keys(raw, lower=True).alias("m"))
    return rows.select("application_id", *[F.col("m")[k].alias(k) for k in ("name", "phone", "dob", "surname")])


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / 300000 END, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE least(0.7, o_totalprice / 200000) END) >= 0.8 IS NOT FALSE AS passed FROM orders")
def p8_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    scores = F.when(k % 2 != 0, F.array(F.lit(0.7), price / 200000))
    return I.table(spark, sf_dir, "orders").select("o_orderkey", register.passes(F.when(k % 3 != 0, price / 300000), scores, 0.8).alias("passed"))


@query(I.SQL + "SELECT f.application_id, f.name, d.document_type FROM docs d JOIN forms f ON d.application_id = f.application_id")
def j1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.pair(I.documents(spark, sf_dir), I.forms(spark, sf_dir)).select("application_id", F.col("form_name").alias("name"), "document_type")


def _batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = I.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("pos"), "l_shipdate", "l_quantity").dropDuplicates(["batch_id", "pos"])
    files = items.select("batch_id", "pos", F.concat_ws("/", F.lit("up"), "batch_id", "pos").alias("file"), F.lit("text").alias("extracted_data"), F.when(F.col("pos") % 4 == 3, "unreadable").alias("error"))
    return files, items.where("pos <= 2").select("batch_id", "pos", F.concat(F.lit("form "), F.col("pos").cast("string")).alias("form"))


_BATCH = "WITH items AS (SELECT DISTINCT l_orderkey AS batch_id, l_linenumber AS pos FROM lineitem) "


@query(_BATCH + "SELECT batch_id, pos, CASE WHEN pos <= 2 THEN 'form ' || pos END AS form FROM items")
def j2_positional_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, forms = _batches(spark, sf_dir)
    return register.positional_pairs(files, forms).select("batch_id", "pos", "form")


@query(_BATCH + "SELECT batch_id, count(*) AS total_files, count(*) FILTER (pos % 4 <> 3) AS successful, count(*) FILTER (pos % 4 = 3) AS failed FROM items GROUP BY batch_id")
def a5_batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.batch_counts(register.batch_rows(*_batches(spark, sf_dir)))


@query(_BATCH + "SELECT batch_id, pos, CASE WHEN pos % 4 = 3 THEN 'error' ELSE 'success' END AS status, CASE WHEN pos % 4 <> 3 THEN 'PRE' || upper(left(sha256(batch_id || '/' || pos), 10)) END AS registration_id, CASE WHEN pos % 4 <> 3 THEN CAST(pos AS VARCHAR) END AS upload FROM items")
def e12_batch_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.batch_rows(*_batches(spark, sf_dir)).select("batch_id", "pos", "status", "registration_id", "upload")


@query("SELECT p_partkey, coalesce(CASE lower(p_brand) WHEN 'brand#1' THEN 'first' WHEN 'brand#2' THEN 'second' END, lower(p_brand)) AS named FROM part")
def j3_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.lower("p_brand")
    return I.table(spark, sf_dir, "part").select("p_partkey", F.coalesce(D.lookup({"brand#1": "first", "brand#2": "second"}, key), key).alias("named"))


# Normal forms


def _sql_latin(c: str) -> str:
    """to_latin() by its characters' readings; the scripts from U+0900 on, but for Latin, Greek and marks, are n1_every_script's and stay here."""
    read = {ch: latin.read(ch)[1] for ch in map(chr, [*range(0x80, 0x900), *range(0x1E00, 0x20D0)])}
    sounds = {ch: sound.replace("'", "''") for ch, sound in read.items() if sound != ch}
    return f"array_to_string(list_transform(regexp_extract_all(nfc_normalize(regexp_replace(coalesce({c}, ''), '[\\x00-\\x1F\\x7F]', '', 'g')), '(?s).'), lambda x: CASE WHEN unicode(x) < 128 THEN x ELSE {_sql_case(sounds, 'x')} END), '')"


@query(f"SELECT doc_id, {_sql_latin('text')} AS latin FROM documents")
def n1_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "documents").select("doc_id", N.to_latin("text").alias("latin"))


@query("SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM documents")
def n2_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "documents").select("doc_id", N.digits(F.col("text")).alias("digits"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def n3_iso_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    text = F.when(k == 0, F.date_format(d, "dd/MM/yyyy")).when(k == 1, F.date_format(d, "yyyy.M.d")).when(k == 2, F.date_format(d, "d MMM yyyy")).when(k == 3, F.date_format(d, "MMMM d, yyyy"))
    text = text.when(k == 4, F.date_format(d, "dd-MMM-yy")).otherwise(F.date_format(d, "d-M-yy"))
    return I.table(spark, sf_dir, "orders").select("o_orderkey", N.iso_date(text).alias("iso"))


@query(I.SQL + f"SELECT application_id, {_sql_expand('address')} AS expanded, {_sql_stop(_sql_expand('address'))} AS kept, {_sql_generic('address')} AS normal FROM (SELECT application_id, house || '/B, ' || road || '. By the Stn (Dist.) India' AS address FROM people)")
def n6_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.people(spark, sf_dir).select("application_id", F.concat("house", F.lit("/B, "), "road", F.lit(". By the Stn (Dist.) India")).alias("address"))
    a = F.col("address")
    rows = rows.select("application_id", N.expand(a).alias("expanded"), N.generic(a).alias("normal"))
    return rows.select("application_id", "expanded", N.drop_stop_tokens(F.col("expanded")).alias("kept"), "normal")


@query(f"SELECT c_custkey, {_sql_map({k: v for k, v in D.GENDERS.items()}, 'g')} AS gender FROM (SELECT c_custkey, ['m', 'female', 'boy', 'महिला', 'non-binary', 'unknown', '', 'लड़की', 'लड़का'][c_custkey % 9 + 1] AS g FROM customer)")
def n7_gender(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.element_at(F.array(*[F.lit(x) for x in (" M", "Female ", "boy", "महिला", "Non-Binary", "Unknown", "", "लड़की", "लड़का")]), F.expr("cast(c_custkey % 9 + 1 as int)"))
    return I.table(spark, sf_dir, "customer").select("c_custkey", N.gender(given).alias("gender"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS ymd, strftime(o_orderdate, '%m-%d') AS md FROM orders")
def n8_loose_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(d, "d.M.yyyy")).when(k == 1, F.date_format(d, "yyyy/MM/dd")).when(k == 2, F.date_format(d, "d MMM, yyyy")).otherwise(F.concat(F.lit("DOB: "), F.date_format(d, "dd-MM-yyyy")))
    rows = I.table(spark, sf_dir, "orders").select("o_orderkey", N.loose_date(text).alias("loose"))
    return rows.select("o_orderkey", "loose.ymd", "loose.md")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d%m') || '20' || strftime(o_orderdate, '%y') WHEN 1 THEN strftime(o_orderdate, '%d%m%Y') ELSE '0' || right(strftime(o_orderdate, '%d%m%Y'), 7) END AS digits FROM orders")
def n9_date_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format(d, "dd/MM/yy")).when(k == 1, F.date_format(d, "dd-MM-yyyy")).otherwise(F.right(F.date_format(d, "ddMMyyyy"), F.lit(7)))
    return I.table(spark, sf_dir, "orders").select("o_orderkey", N.date_digits(text).alias("digits"))


@query(
    f"""WITH a AS (SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') / 365.25 AS DOUBLE) AS years, CAST(o_orderkey % 40 AS INTEGER) AS stated FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'age_parse_error' WHEN abs(CAST(floor(years) AS INTEGER) - stated) > 1 THEN 'age_mismatch(derived=' || CAST(floor(years) AS INTEGER) || ', stated=' || stated || ')' END AS note FROM a"""
)
def n11_age_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    dob = F.date_format("o_orderdate", "d/M/yyyy")
    age = F.when(F.col("o_orderkey") % 11 == 0, "old").otherwise((F.col("o_orderkey") % 40).cast("string"))
    return I.table(spark, sf_dir, "orders").select("o_orderkey", N.age_note(dob, age, F.lit(AS_OF).cast("date")).alias("note"))


# Fuzzy ratios


_PAIRS = X.NAME_PAIRS


def _ratio(a: str, b: str) -> str:
    return f"200.0 * {X.lcs(a, b)} / (length({a}) + length({b}))"


def _all_ratios(column: str) -> str:
    return f"{_PAIRS}, {X.fuzzy('pairs', '')} SELECT application_id, {column} AS ratio FROM pairs JOIN fz USING (a, b)"


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, f = I.people(spark, sf_dir), I.forms(spark, sf_dir)
    return p.join(f.select("application_id", "name"), "application_id").select("application_id", F.lower(F.concat_ws(" ", "first", "last")).alias("a"), F.lower("name").alias("b"))


@query(_PAIRS + f" SELECT application_id, {_ratio('a', 'b')} AS ratio FROM pairs")
def f1_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir).select("application_id", fuzzy.best_of("ratio")("a", "b").alias("ratio"))


@query(_PAIRS + f" SELECT application_id, {_ratio('a', 'b')} AS ratio FROM pairs")
def f1_ratio_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir).select("application_id", fuzzy.ratio_column(F.col("a"), F.col("b")).alias("ratio"))


@query(_PAIRS + ", s AS (SELECT application_id, array_to_string(list_sort(string_split(a, ' ')), ' ') AS a, array_to_string(list_sort(string_split(b, ' ')), ' ') AS b FROM pairs)" + f" SELECT application_id, {_ratio('a', 'b')} AS ratio FROM s")
def f2_token_sort_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir).select("application_id", fuzzy.best_of("token_sort_ratio")("a", "b").alias("ratio"))


@query(
    _PAIRS
    + """, t AS (SELECT application_id, list_sort(list_filter(string_split(a, ' '), lambda x: list_contains(string_split(b, ' '), x))) AS s, list_sort(list_filter(string_split(a, ' '), lambda x: NOT list_contains(string_split(b, ' '), x))) AS l,
    list_sort(list_filter(string_split(b, ' '), lambda x: NOT list_contains(string_split(a, ' '), x))) AS r FROM pairs), u AS (SELECT application_id, len(s) > 0 AND (len(l) = 0 OR len(r) = 0) AS whole, len(s) = 0 AS apart,
    array_to_string(s, ' ') AS s, array_to_string(list_concat(s, l), ' ') AS a, array_to_string(list_concat(s, r), ' ') AS b FROM t)"""
    + f" SELECT application_id, CASE WHEN whole THEN 100.0 WHEN apart THEN {_ratio('a', 'b')} ELSE greatest({_ratio('a', 'b')}, {_ratio('s', 'a')}, {_ratio('s', 'b')}) END AS ratio FROM u"
)
def f3_token_set_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir).select("application_id", fuzzy.best_of("token_set_ratio")("a", "b").alias("ratio"))


@query(_all_ratios("part"))
def f4_partial_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir).select("application_id", fuzzy.best_of("partial_ratio")("a", "b").alias("ratio"))


@query(_all_ratios("weighted"))
def f5_weighted_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir).select("application_id", fuzzy.best_of("weighted_ratio")("a", "b").alias("ratio"))


# Scores


@query(f"{_PAIRS}, {X.fuzzy('pairs', '')}, {X.name_scores('')} SELECT application_id, score FROM pairs JOIN ns USING (a, b)")
def c1_name_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _name_pairs(spark, sf_dir).withColumn("f", C.name_ratio("a", "b"))
    return rows.select("application_id", C.name_score(F.col("a"), F.col("b"), F.col("f")).alias("score"))


@query(I.SQL + f", pairs AS (SELECT application_id, {_sql_generic('x')} AS a, {_sql_generic('y')} AS b FROM (SELECT p.application_id, p.house || ' ' || p.road AS x, CASE WHEN p.application_id % 3 = 0 THEN p.road ELSE f.address END AS y FROM people p JOIN forms f USING (application_id))), {X.fuzzy('pairs', '')}, {X.address_scores('')} SELECT application_id, score FROM pairs JOIN ads USING (a, b)")
def c2_address_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, f = I.people(spark, sf_dir), I.forms(spark, sf_dir)
    rows = p.join(f.select("application_id", "address"), "application_id").withColumn("address", F.when(F.col("application_id") % 3 == 0, F.col("road")).otherwise(F.col("address"))).select("application_id", N.generic(F.concat_ws(" ", "house", "road")).alias("a"), N.generic(F.col("address")).alias("b"))
    return rows.withColumn("f", C.address_ratio("a", "b")).select("application_id", C.address_score(F.col("a"), F.col("b"), F.col("f")).alias("score"))


@query(
    "SELECT p_partkey, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS all_tokens, CAST(len(list_intersect(a, b)) AS DOUBLE) / greatest(1, len(a), len(b)) AS coverage FROM (SELECT p_partkey, list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split(lower(p_type), ' '), lambda x: x <> '')) AS b FROM part)"
)
def c2_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = C.token_overlap(F.lower("p_name"), F.lower("p_type"))
    return I.table(spark, sf_dir, "part").select("p_partkey", t["shared"].cast("long").alias("shared"), t["all"].cast("long").alias("all_tokens"), t["coverage"].alias("coverage"))


@query(I.SQL + f"SELECT application_id, CAST({_PHONE} AS DOUBLE) AS score FROM (SELECT p.application_id, '91' || p.phone AS a, CASE WHEN p.application_id % 7 = 0 THEN left(f.phone, 7) ELSE f.phone END AS b FROM people p JOIN forms f USING (application_id))")
def c3_phone_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, f = I.people(spark, sf_dir), I.forms(spark, sf_dir)
    given = F.when(F.col("application_id") % 7 == 0, F.left("typed", F.lit(7))).otherwise(F.col("typed"))
    rows = p.join(f.select("application_id", F.col("phone").alias("typed")), "application_id").select("application_id", N.digits(F.concat(F.lit("+91 "), "phone")).alias("a"), N.digits(given).alias("b"))
    return rows.select("application_id", C.phone_score(F.col("a"), F.col("b")).alias("score"))


_DOB = "CASE WHEN application_id % 5 = 0 THEN 0.0 ELSE 1.0 END"


@query(I.SQL + f"SELECT application_id, CAST({_DOB} AS DOUBLE) AS score FROM people")
def c4_dob_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, f = I.people(spark, sf_dir), I.forms(spark, sf_dir)
    rows = p.join(f, "application_id").select("application_id", C.date_forms(F.date_format("born", "d MMM yyyy")).alias("a"), C.date_forms(F.col("dob")).alias("b"))
    return rows.select("application_id", C.dob_score(F.col("a"), F.col("b")).alias("score"))


@query("SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS DOUBLE) AS score FROM customer")
def c5_gender_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    a = F.when(k == 0, "").when(k == 1, "Man").otherwise("अन्य")
    return I.table(spark, sf_dir, "customer").select("c_custkey", C.gender_score(a, F.when(k == 1, " male").otherwise("other")).alias("score"))


# Aggregates


@query(
    """WITH s AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS has_name, o_totalprice / 500000 AS n, CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE 1.0 END AS d FROM orders), c AS (
    SELECT *, CASE WHEN has_name THEN 0.35 / (0.35 + 0.30) * n ELSE 0 END + 0.30 / (CASE WHEN has_name THEN 0.35 ELSE 0 END + 0.30) * d AS raw FROM s)
    SELECT o_orderkey, CAST(round(raw, 4) AS DOUBLE) AS overall_confidence, CASE WHEN raw >= 0.85 THEN 'MATCH' WHEN raw >= 0.6 THEN 'REVIEW' ELSE 'MISMATCH' END AS decision,
    CAST((has_name AND n < 0.6) AS INTEGER) + CAST(d < 0.6 AS INTEGER) AS n_notes FROM c"""
)
def a1_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    scores = {"name": F.col("o_totalprice") / 500000, "dob": F.when(k % 5 == 0, 0.0).otherwise(1.0)}
    has = {"name": k % 2 == 0, "dob": F.lit(True)}
    weights = {f: D.WEIGHTS[f] for f in scores}
    raw = verify.confidence(scores, has, weights)
    return I.table(spark, sf_dir, "orders").select(k, F.round(raw, 4).alias("overall_confidence"), verify.decision(raw).alias("decision"), F.size(verify.low_notes(scores, has, weights)).alias("n_notes"))


@query("SELECT o_custkey, avg(coalesce(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice / 500000 END, 1.0)) AS average_confidence FROM orders GROUP BY o_custkey")
def a6_average_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice") / 500000).alias("confidence"))
    return review.average_confidence(rows, "o_custkey")


# Windows in disguise


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def w1_first_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.first_by_priority(I.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS last_value FROM orders GROUP BY o_custkey")
def w2_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as lines with the same label: the last one's value stays."""
    rows = I.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("rows"))
    lines = F.transform("rows", lambda r: F.concat(F.lit("City: "), r["o_orderpriority"]))
    return rows.select("o_custkey", extract.found_values(F.array_join(lines, "\n")).alias("found")).select("o_custkey", F.col("found")["l_city"].alias("last_value"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ['Last Name: ' || o_orderpriority] ELSE ['Last Name', 'First Name: ' || o_orderpriority] END AS lines FROM orders")
def w4_next_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's value is the next line, unless that begins with a label."""
    after = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit("First Name: "), "o_orderpriority"))
    orders = I.table(spark, sf_dir, "orders").repartition(spark.sparkContext.defaultParallelism, "o_orderkey")  # one small file, one task by itself
    return orders.select("o_orderkey", ocrlines.normalise_lines(F.array(F.lit("Last Name"), after)).alias("lines"))


_WORDS = ["ঢাকা", "சென்னை", "తెలుగు", "ಮೈಸೂರು", "കൊച്ചി", "સુરત", "ਪੰਜਾਬ", "Москва", "Αθήνα", "سلام", "“Rao’s” –", "Łódź", "दिल्ली", "서울"]
_IN_LATIN = ["dhaka", "chennai", "telugu", "maisuru", "kochchi", "surat", "panjab", "Moskva", "Athena", "slam", '"Rao\'\'s" -', "Lodz", "dilli", "seoul"]


@query(f"SELECT c_custkey, [{', '.join(f"'{w}'" for w in _IN_LATIN)}][c_custkey % {len(_WORDS)} + 1] || ' ' || c_custkey AS latin FROM customer")
def n1_every_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of fourteen scripts and styles, and numbers in Devanagari digits, in Latin letters."""
    word = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), F.expr(f"cast(c_custkey % {len(_WORDS)} + 1 as int)"))
    number = F.translate(F.col("c_custkey").cast("string"), "0123456789", "०१२३४५६७८९")
    return I.table(spark, sf_dir, "customer").select("c_custkey", N.to_latin(F.concat(word, F.lit(" "), number)).alias("latin"))


@query(I.SQL + "SELECT application_id, CAST(0.75 AS DOUBLE) AS overall_confidence, 'REVIEW' AS decision, ['verification_skipped_no_overlap'] AS notes FROM people WHERE application_id % 5 = 3")
def p5_no_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of forms in two languages, short ones and pages without a label: those that share no field with the applicant's form."""
    docs = I.mixed_documents(spark, sf_dir).withColumn("document_type", F.lit(None).cast("string"))
    rows = verify.map_and_verify(docs, I.forms(spark, sf_dir))
    return rows.where(F.col("fields").isNull()).select("application_id", "overall_confidence", "decision", "notes")


_GRAMS = "list_distinct(list_transform(range(1, length(line)), lambda i: substr(line, CAST(i AS INTEGER), 2)))"


@query(
    I.SQL
    + f""", d AS (SELECT application_id, born, ' ' || array_to_string(list_sort(string_split(lower(first || ' ' || last || ' ' || {{tag}}), ' ')), ' ') || ' ' AS line FROM people),
    f AS (SELECT p.application_id, p.born, ' ' || array_to_string(list_sort(string_split(lower(f.name || ' ' || {{tag}}), ' ')), ' ') || ' ' AS line FROM people p JOIN forms f USING (application_id)),
    x AS (SELECT application_id, born, {_GRAMS} AS g FROM d), y AS (SELECT application_id, born, {_GRAMS} AS g FROM f),
    pairs AS (SELECT x.application_id AS doc_key, y.application_id AS form_key, len(list_intersect(x.g, y.g)) AS n, len(x.g) + len(y.g) AS m FROM x JOIN y ON x.born = y.born)
    SELECT doc_key, form_key, round(n / (m - n), 9) AS jaccard FROM pairs WHERE n / (m - n) >= 0.6 - 1e-9""".replace("{tag}", "translate(CAST(application_id * 7919 % 100000 AS VARCHAR), '0123456789', 'bcdfghjkmz')").replace("born AS", "born AS")
)
def j1_alike_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and forms without a shared key, linked by alike names and equal dates of birth."""
    tag = F.expr("translate(cast(application_id * 7919 % 100000 as string), '0123456789', 'bcdfghjkmz')")
    docs = I.people(spark, sf_dir).select(F.col("application_id").alias("doc_key"), F.concat_ws(" ", "first", "last", tag).alias("name"), F.date_format("born", "dd MMM yyyy").alias("dob"))
    born = I.people(spark, sf_dir).select("application_id", F.date_format("born", "yyyy/MM/dd").alias("dob"))
    forms = I.forms(spark, sf_dir).drop("dob").join(born.hint("merge"), "application_id").select(F.col("application_id").alias("form_key"), F.concat_ws(" ", "name", tag).alias("name"), "dob")
    return link.linked(docs, forms).select("doc_key", "form_key", F.round("jaccard", 9).alias("jaccard"))


# Review


@query(I.SQL + "SELECT application_id, CASE WHEN application_id % 4 = 0 THEN 'Edited' ELSE first || ' ' || last END AS name, CASE application_id % 3 WHEN 0 THEN 'aadhar' WHEN 1 THEN 'dl' ELSE 'birth' END AS document, house || ' ' || road || ', ' || city || ', ' || state || ', ' || pin AS address FROM people")
def u1_review_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("application_id")
    slot = F.when(k % 3 == 0, "name").when(k % 3 == 1, "address").otherwise("dob")
    docs = I.documents(spark, sf_dir).select("application_id", F.regexp_replace("raw_text", r"\.\n", "\n").alias("raw"))
    return I.people(spark, sf_dir).join(docs, "application_id").select(
        "application_id",
        review.form_name(F.when(k % 4 == 0, "Edited").otherwise(""), F.col("first"), F.lit(""), F.col("last")).alias("name"),
        review.slot_document(slot).alias("document"),
        review.address_line(F.concat_ws(" ", "house", "road"), F.lit(None).cast("string"), F.col("state"), F.lit(""), F.col("raw")).alias("address"),
    )


@query(I.SQL + "SELECT application_id, ['Name: ' || first, 'City: ' || city, 'Email: ' || mail, 'extra: ' || pin] AS lines FROM people")
def u5_labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.create_map(F.lit("extra"), F.col("pin"), F.lit("email"), F.concat(F.lit(" ID: "), "mail"), F.lit("CITY"), F.lit(" "), F.lit("City"), F.col("city"), F.lit("name"), F.col("first"), F.lit("Phone"), F.lit(""))
    return I.people(spark, sf_dir).select("application_id", review.labelled_lines(record).alias("lines"))


@query(
    "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 2 END::BIGINT AS place, "
    "CASE o_orderkey % 5 WHEN 0 THEN 'Handwritten (All Fields)' WHEN 1 THEN 'Aadhaar/Voter ID (Name)' WHEN 2 THEN 'Birth/SLC (DOB)' ELSE 'DL/Passport (Address)' END AS label FROM orders WHERE o_orderkey % 5 < 4"
)
def w5_display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.element_at(F.array(*[F.lit(x) for x in ("handwritten", "name", "dob", "address", "other")]), F.expr("cast(o_orderkey % 5 + 1 as int)"))
    return review.shown_slots(I.table(spark, sf_dir, "orders").select("o_orderkey", slot.alias("slot"))).select("o_orderkey", "place", "label")


@query("SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.55 ELSE 0.6 END AS DOUBLE) AS confidence FROM orders")
def u6_edited_dob(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    after = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(F.date_add(d, 400), "MM/dd/yyyy")).otherwise("soon")
    return I.table(spark, sf_dir, "orders").select("o_orderkey", review.edited_dob_confidence(F.date_format(d, "MM/dd/yyyy"), after).alias("confidence"))


@query("SELECT o_orderkey, CAST(round(o_totalprice / 500000 * 100) AS INTEGER) AS percent, o_totalprice / 500000 < 0.6 AS low, CASE o_orderstatus WHEN 'F' THEN 'danger' WHEN 'O' THEN 'warning' ELSE 'secondary' END AS shown FROM orders")
def u7_percent_and_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_totalprice") / 500000
    status = F.when(F.col("o_orderstatus") == "F", "Failed: x").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("other")
    return I.table(spark, sf_dir, "orders").select("o_orderkey", review.percent(s).alias("percent"), (s < review.LOW).alias("low"), review.status_class(status).alias("shown"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE o_orderstatus END AS status FROM orders")
def u8_reviewed_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return review.reviewed_again(rows, rows.where("o_orderkey % 3 = 0").withColumn("status", F.lit("changed")), "o_orderkey")


@query("SELECT o_custkey, max_by('PRE' || o_orderkey, o_orderkey) AS registration_id FROM orders GROUP BY o_custkey")
def u13_last_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("PRE"), F.col("o_orderkey").cast("string")).alias("registration_id"))
    return review.last_registration(rows, "o_custkey", "o_orderkey")


@query(_BATCH + "SELECT batch_id, pos, 'form ' || batch_id AS form FROM items")
def u14_batch_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _ = _batches(spark, sf_dir)
    form = I.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch_id"), F.concat(F.lit("form "), F.col("o_orderkey").cast("string")).alias("form")).dropDuplicates(["batch_id"])
    return review.forms_for_files(files.select("batch_id", "pos"), form)


# Whole flows


@query(
    I.SQL + ", " + X.verified(X.RESTRICTED, _sql_generic, _PHONE) + ", extracted AS (" + _FULL_ROWS + ") "
    + "SELECT application_id, document_type, " + ", ".join(f"CASE WHEN free OR document_type IN ({', '.join(repr(k) for k, fs in D.DOCUMENT_FIELDS.items() if f in fs) or 'NULL'}) THEN {f} END AS doc_{f}" for f in D.FIELDS)
    + f", missing_fields, overall_confidence, decision, {_SCORES}, notes FROM (SELECT *, document_type IS NULL OR document_type = 'handwritten' AS free FROM extracted) JOIN done USING (application_id)"
)
def e5_map_and_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verify.map_and_verify(I.documents(spark, sf_dir), I.forms(spark, sf_dir), F.lit(AS_OF).cast("date"))
    return rows.select("application_id", "document_type", *[f"doc_{f}" for f in D.FIELDS], "missing_fields", "overall_confidence", "decision", *_field_scores(), "notes")


def _field_scores() -> list:
    return [F.col("fields")[f].alias(f"f_{f}") for f in D.SCORED]


def e6_verify_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.people(spark, sf_dir).select(
        "application_id", F.concat_ws(" ", "first", "last").alias("name"), F.date_format("born", "d MMM yyyy").alias("dob"), F.col("sex").alias("gender"), F.concat_ws(" ", "house", "road").alias("address"), F.concat(F.lit("+91 "), "phone").alias("phone")
    )
    return verify.verify(verify.pair(p, I.forms(spark, sf_dir)), as_of=F.lit(AS_OF).cast("date"))


@query(f"{_FLOW} SELECT application_id, overall_confidence, decision, {_SCORES}, notes, 'a3-v1' AS version FROM done")
def e6_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e6_verify_pairs(spark, sf_dir).select("application_id", "overall_confidence", "decision", *_field_scores(), "notes", "version")


_REGISTRATION = "'PRE' || upper(left(sha256(CAST(application_id AS VARCHAR)), 10))"


@query(f"{_FLOW} SELECT application_id, overall_confidence, decision, CASE WHEN overall_confidence >= 0.8e0 THEN 'success' ELSE 'verification_failed' END AS status, CASE WHEN overall_confidence >= 0.8e0 THEN {_REGISTRATION} END AS registration_id FROM done")
def e8_integrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = register.integrate(I.documents(spark, sf_dir), I.forms(spark, sf_dir))
    return rows.select("application_id", "overall_confidence", "decision", "status", "registration_id")


@query(I.SQL + ", " + X.verified(f"(SELECT application_id, dn, fn, CAST(NULL AS DOUBLE) AS dd, '' AS da, '' AS fa, dp, fp, FALSE AS dg FROM {X.PEOPLE})", _sql_generic, _PHONE) + f" SELECT application_id, overall_confidence, {_REGISTRATION} AS registration_id, 'success' AS status FROM done")
def e9_verify_and_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.people(spark, sf_dir).select("application_id", F.concat_ws(" ", "first", "last").alias("name"), "phone")
    return register.verify_and_submit(verify.pair(p, I.forms(spark, sf_dir))).select("application_id", "overall_confidence", "registration_id", "status")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE 'd' || c_custkey END AS dob FROM customer")
def u4_any_dob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of birth under whichever key a record has it, empty ones passed over."""
    k, value = F.col("c_custkey"), F.concat(F.lit("d"), "c_custkey")
    key = F.element_at(F.array(*[F.lit(x) for x in ("dob", "date_of_birth", "birth_date", "DOB", "born")]), F.expr("cast(c_custkey % 5 + 1 as int)"))
    record = F.map_concat(F.create_map(key, value), F.when(k % 5 > 0, F.create_map(F.lit("dob"), F.lit(""))).otherwise(F.create_map(F.lit("x"), F.lit("y"))))
    return I.table(spark, sf_dir, "customer").select("c_custkey", review.any_dob(record).alias("dob"))


_SENT = {"name": "identity", "dob": "birth", "gender": "identity", "address": "address", "phone": "identity", "email": "identity"}


@query(
    I.SQL
    + ", s AS (SELECT *, CASE WHEN application_id % 2 = 0 THEN 'id.png' ELSE '' END AS identity, CASE WHEN application_id % 3 = 0 THEN 'ad.png' END AS addr, CASE WHEN application_id % 5 = 0 THEN 'dob.png' END AS birth FROM forms) SELECT application_id, "
    "coalesce(nullif(identity, ''), addr, birth) AS primary_document, CASE WHEN identity <> '' THEN name END AS name, CASE WHEN birth IS NOT NULL THEN dob END AS dob, CASE WHEN identity <> '' THEN gender END AS gender, "
    "CASE WHEN addr IS NOT NULL THEN address END AS address, CASE WHEN identity <> '' THEN phone END AS phone, CASE WHEN identity <> '' THEN email END AS email FROM s"
)
def u9_sent_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes out with a submission: the first document there is, and only the fields whose document is there."""
    k = F.col("application_id")
    rows = I.forms(spark, sf_dir).select("*", F.when(k % 2 == 0, "id.png").otherwise("").alias("d_identity"), F.when(k % 3 == 0, "ad.png").alias("d_address"), F.when(k % 5 == 0, "dob.png").alias("d_birth"))
    fields = [review.given_if(pytext.present(F.col(f"d_{doc}")), F.col(f)).alias(f) for f, doc in _SENT.items()]
    return rows.select("application_id", review.primary_document(F.col("d_identity"), F.col("d_address"), F.col("d_birth")).alias("primary_document"), *fields)


@query(
    I.SQL
    + """SELECT application_id, list_filter([CASE WHEN application_id % 7 = 0 THEN 'first_name' END, CASE WHEN application_id % 11 = 0 THEN 'dob' END, CASE WHEN application_id % 3 = 0 THEN 'gender' END,
    CASE WHEN application_id % 5 = 0 THEN 'email' END, CASE WHEN application_id % 13 = 0 THEN 'phone' END], lambda x: x IS NOT NULL) AS problems FROM people"""
)
def u12_form_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("application_id")
    rows = I.people(spark, sf_dir).select(
        "application_id", F.when(k % 7 == 0, " ").otherwise(F.col("first")).alias("first_name"), F.col("last").alias("last_name"), F.when(k % 11 == 0, "1990-02-30").otherwise(F.date_format("born", "yyyy-MM-dd")).alias("dob"),
        F.when(k % 3 == 0, "m").otherwise(F.col("sex")).alias("gender"), F.when(k % 5 == 0, "a@b@c").otherwise(F.col("mail")).alias("email"), F.when(k % 13 == 0, None).otherwise(F.col("phone")).alias("phone"), F.col("road").alias("address"),
    )
    return rows.select("application_id", review.form_problems().alias("problems"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'plain' END AS shown FROM customer")
def u15_shown_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))
    return I.table(spark, sf_dir, "customer").select("c_custkey", review.shown_value(value, F.lit("plain")).alias("shown"))


@query(
    I.SQL
    + """SELECT '{"user":{"name":"' || f.name || '","dob":"' || f.dob || '"},"documents":{"name":{"document_type":"aadhar","fields":{"name":"' || p.first || ' ' || p.last || '"}},"address":{"document_type":"dl","fields":{"city":"' || p.city
    || '","state":"' || p.state || '"}}},"timestamp":"x"}' AS value FROM forms f JOIN people p USING (application_id)"""
)
def s11_export_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole review: what the applicant typed, and what was read, by document slot."""
    rows = I.forms(spark, sf_dir).select("application_id", "name", "dob").join(I.people(spark, sf_dir).drop("dob"), "application_id")
    slots = {
        "name": F.struct(F.lit("aadhar").alias("document_type"), F.struct(F.concat_ws(" ", "first", "last").alias("name")).alias("fields")),
        "address": F.struct(F.lit("dl").alias("document_type"), F.struct("city", "state").alias("fields")),
    }
    return sinks.export_json(rows, user=F.struct("name", "dob"), documents=F.struct(*[c.alias(k) for k, c in slots.items()]), timestamp=F.lit("x"))
