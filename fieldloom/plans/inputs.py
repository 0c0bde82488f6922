"""Documents and forms made in-plan from the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = ["Ramesh", "Anita", "Suresh", "Kavita", "Mohan", "Priya", "Arjun"]
LAST = ["Kumar", "Sharma", "Patel", "Reddy", "Iyer"]
ROADS = ["Gandhi St", "MG Rd", "Park Ave", "Temple Ln Nr Lake"]
CITIES = ["Bangalore", "Mumbai", "Pune"]
STATES = ["Karnataka", "Maharashtra", "Maharashtra"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table that is one small file, and so one task by itself, dealt out by key: what is made of its rows is worth more."""
    return table(spark, sf_dir, name).repartition(spark.sparkContext.defaultParallelism, key)


def _pick(values: list[str], key: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.expr(key) + 1).cast("int"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(application_id, first, last, born, sex, house, road, city, state, pin, phone, mail, as_age)."""
    k = "c_custkey"
    born = F.date_add(F.lit("1960-01-01").cast("date"), F.expr(f"cast({k} * 37 % 16000 as int)"))
    return spread(spark, sf_dir, "customer", k).select(
        F.col(k).alias("application_id"),
        _pick(FIRST, f"{k} % 7").alias("first"),
        _pick(LAST, f"{k} % 5").alias("last"),
        born.alias("born"),
        F.when(F.expr(f"{k} % 2") == 0, "Male").otherwise("Female").alias("sex"),
        F.expr(f"cast({k} % 90 + 1 as string)").alias("house"),
        _pick(ROADS, f"{k} % 4").alias("road"),
        _pick(CITIES, f"{k} % 3").alias("city"),
        _pick(STATES, f"{k} % 3").alias("state"),
        F.expr(f"cast(560000 + {k} % 1000 as string)").alias("pin"),
        F.expr(f"cast(9000000000 + {k} * 7919 % 999999999 as string)").alias("phone"),
        F.expr(f"concat('user', {k}, '@qmail.com')").alias("mail"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(application_id, raw_text, document_type): a form as it would be read off paper."""
    p = people(spark, sf_dir)
    text = F.concat(
        F.lit("First Name: "), "first", F.lit("\nLast Name: "), "last", F.lit("\nDOB: "), F.date_format("born", "dd/MM/yyyy"), F.lit("\nGender: "), "sex",
        F.lit("\nAddress: "), "house", F.lit(" "), "road", F.lit("\nCity: "), "city", F.lit(".\nState: "), "state", F.lit(".\nPin Code: "), "pin",
        F.lit("\nPhone: +91 "), "phone", F.lit("\nEmail: "), F.upper("mail"),
    )
    kinds = [None, "aadhar", "dl", "birth", "passport", "handwritten"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.expr("cast(application_id % 6 + 1 as int)"))
    return p.select("application_id", text.alias("raw_text"), kind.alias("document_type"))


#: Forms in two languages and three states: what stands before each value, in the order of a form.
LABELS = {
    "en": ["FIRST NAME: ", "MIDDLE NAME: ", "LAST NAME: ", "Gender: ", "Date of birth: ", "Age: ", "Address Line 1: ", "Address Line 2: ", "City: ", "State: ", "Pin Code: ", "Phone number: ", "Email Id: "],
    "hi": ["प्रथम नाम: ", "मध्य नाम: ", "अंतिम नाम: ", "लिंग: ", "जन्म तिथि: ", "उम्र: ", "पता पंक्ति १: ", "पता पंक्ति २: ", "शहर: ", "राज्य: ", "पिनकोड: ", "फोन: ", "ईमेल: "],
    "noisy": ["FUEST MOUNT ", "Middle  Name:", "Last name: ", "Chender:", "DOB : ", "years ", "ADDREAS LINE 1 ", "addreas lin 2:", "CITY ", "STATE : ", "Prin CODE ", "mobile:: ", "e-mail "],
}
PARTS = ["first_name", "middle_name", "last_name", "gender", "dob", "age", "address_line1", "address_line2", "city", "state", "pincode", "phone", "email"]
HINDI = ["रमेश", "अनीता", "सुरेश", "कविता", "मोहन", "प्रिया", "अर्जुन"]
KINDS = ["en", "hi", "noisy", "bare", "short"]


def mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(application_id, kind, raw_text): whole forms in two languages, one badly read, pages without a label, and forms with a name and a place alone."""
    p = people(spark, sf_dir)
    k = F.col("application_id")
    hindi = _pick(HINDI, "application_id % 7")
    kind = _pick(KINDS, "application_id % 5")
    own = {
        "en": ["first", F.lit("Dev"), "last", "sex", F.date_format("born", "dd-MM-yyyy"), (k % 90 + 10).cast("string"), F.concat("house", F.lit(" "), "road"), F.concat(F.lit("Floor "), "house"), F.concat("city", F.lit(".")), F.concat("state", F.lit(".")), "pin", F.concat(F.lit("+91 "), "phone"), F.upper("mail")],
    }
    own["noisy"] = own["en"]
    own["hi"] = [hindi, F.lit("कुमार"), F.lit("शर्मा"), F.when(k % 2 == 0, "पुरुष").otherwise("महिला"), *own["en"][4:6], F.concat("house", F.lit(", एमजी रोड")), F.concat(F.lit("मंज़िल "), "house"), F.lit("दिल्ली"), F.lit("दिल्ली प्रदेश"), *own["en"][10:]]
    whole = {lang: F.concat_ws("\n", *[F.concat(F.lit(label), v if not isinstance(v, str) else F.col(v)) for label, v in zip(LABELS[lang], own[lang], strict=True)]) for lang in own}
    short = F.concat(F.lit("full name - "), "first", F.lit(" "), "last", F.lit("\nCity: "), "city", F.lit(".\nState: "), "state", F.lit(".\nPincode: "), "pin")
    text = F.when(kind == "short", short).when(kind == "bare", F.concat(F.lit("page "), k.cast("string"), F.lit("\nnothing that is a field\n--")))
    for lang, c in whole.items():
        text = text.when(kind == lang, c)
    return p.select("application_id", kind.alias("kind"), text.alias("raw_text"))


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(application_id, name, dob, gender, address, phone, email): what the applicant typed, with slips by key."""
    p = people(spark, sf_dir)
    name = F.expr("case application_id % 4 when 0 then concat(first, ' ', last) when 1 then concat(last, ' ', first) when 2 then concat(first, ' ', left(last, 1)) else concat(first, 'h ', last) end")
    phone = F.expr("case when application_id % 3 = 0 then right(phone, 8) else phone end")
    dob = F.expr("case when application_id % 5 = 0 then date_format(date_add(born, 1), 'dd-MM-yyyy') else date_format(born, 'dd-MM-yyyy') end")
    address = F.expr("concat(house, ' ', replace(replace(road, 'St', 'Street'), 'Rd', 'Road'))")
    return p.select("application_id", name.alias("name"), dob.alias("dob"), F.lower("sex").alias("gender"), address.alias("address"), phone.alias("phone"), F.lower("mail").alias("email"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: The same tables in DuckDB SQL, as leading common table expressions people, docs and forms.
SQL = f"""
WITH people AS (
  SELECT c_custkey AS application_id, {_sql_list(FIRST)}[c_custkey % 7 + 1] AS first, {_sql_list(LAST)}[c_custkey % 5 + 1] AS last,
    CAST(DATE '1960-01-01' + CAST(c_custkey * 37 % 16000 AS INTEGER) AS DATE) AS born, CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS sex,
    CAST(c_custkey % 90 + 1 AS VARCHAR) AS house, {_sql_list(ROADS)}[c_custkey % 4 + 1] AS road, {_sql_list(CITIES)}[c_custkey % 3 + 1] AS city,
    {_sql_list(STATES)}[c_custkey % 3 + 1] AS state, CAST(560000 + c_custkey % 1000 AS VARCHAR) AS pin,
    CAST(9000000000 + c_custkey * 7919 % 999999999 AS VARCHAR) AS phone, 'user' || c_custkey || '@qmail.com' AS mail
  FROM customer
), docs AS (
  SELECT application_id, 'First Name: ' || first || chr(10) || 'Last Name: ' || last || chr(10) || 'DOB: ' || strftime(born, '%d/%m/%Y') || chr(10) || 'Gender: ' || sex
    || chr(10) || 'Address: ' || house || ' ' || road || chr(10) || 'City: ' || city || '.' || chr(10) || 'State: ' || state || '.' || chr(10) || 'Pin Code: ' || pin
    || chr(10) || 'Phone: +91 ' || phone || chr(10) || 'Email: ' || upper(mail) AS raw_text,
    [NULL, 'aadhar', 'dl', 'birth', 'passport', 'handwritten'][application_id % 6 + 1] AS document_type
  FROM people
), forms AS (
  SELECT application_id, CASE application_id % 4 WHEN 0 THEN first || ' ' || last WHEN 1 THEN last || ' ' || first WHEN 2 THEN first || ' ' || left(last, 1) ELSE first || 'h ' || last END AS name,
    strftime(CASE WHEN application_id % 5 = 0 THEN born + 1 ELSE born END, '%d-%m-%Y') AS dob, lower(sex) AS gender,
    house || ' ' || replace(replace(road, 'St', 'Street'), 'Rd', 'Road') AS address,
    CASE WHEN application_id % 3 = 0 THEN right(phone, 8) ELSE phone END AS phone, lower(mail) AS email
  FROM people
)
"""

_WHOLE = {
    "first_name": "first", "middle_name": "'Dev'", "last_name": "last", "gender": "sex", "dob": "strftime(born, '%d-%m-%Y')", "age": "CAST(application_id % 90 + 10 AS VARCHAR)", "address_line1": "house || ' ' || road",
    "address_line2": "'Floor ' || house", "city": "city", "state": "state", "pincode": "pin", "phone": "'+91 ' || phone", "email": "upper(mail)",
}
_HINDI = {
    "first_name": f"{_sql_list(HINDI)}[application_id % 7 + 1]", "middle_name": "'कुमार'", "last_name": "'शर्मा'", "gender": "CASE WHEN application_id % 2 = 0 THEN 'पुरुष' ELSE 'महिला' END",
    "address_line1": "house || ', एमजी रोड'", "address_line2": "'मंज़िल ' || house", "city": "'दिल्ली'", "state": "'दिल्ली प्रदेश'",
}
_SHORT = {"city": "city", "state": "state", "pincode": "pin"}
#: What mixed_documents() holds, by field, as columns of a table m.
MIXED_SQL = SQL + ", m AS (SELECT *, " + f"{_sql_list(KINDS)}[application_id % 5 + 1] AS kind, " + ", ".join(f"CASE application_id % 5 WHEN 0 THEN {_WHOLE[f]} WHEN 1 THEN {_HINDI.get(f, _WHOLE[f])} WHEN 2 THEN {_WHOLE[f]} WHEN 4 THEN {_SHORT.get(f, 'NULL')} END AS m_{f}" for f in PARTS) + " FROM people) "
