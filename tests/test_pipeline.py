import json

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import extract, ocrlines, register, review, verify
from fieldloom.sources import documents as sources
from fieldloom.sources import sinks

USER = {"name": "Ramesh Kumar", "dob": "19-04-2001", "phone": "9876543210", "address": "B12/3 Gandhi Street MG Road", "gender": "male"}
AS_OF = F.lit


def text(**change):
    f = {"name": "Ramesh Kumar", "dob": "19/04/2001", "gender": "Male", "address": "B12/3 Gandhi Street MG Road", "phone": "+91 98765-43210"} | change
    return f"Name: {f['name']}\nDOB: {f['dob']}\nGender: {f['gender']}\nAddress: {f['address']}\nPhone: {f['phone']}" + (f"\nAge: {f['age']}" if "age" in f else "")


# (changes of the text, changes of the form, field or overall, least, most)
CASES = [
    ({"name": "Kumar Ramesh"}, {}, "name", 0.9, 1.01), ({"name": "Rameesh Kumar"}, {}, "name", 0.9, 1.01), ({"name": "Ramesh Kmr"}, {}, "name", 0.88, 0.95),
    ({"name": "Ramesh K"}, {}, "name", 0.85, 1.01), ({"name": "Ramesh A Kumar"}, {}, "name", 0.9, 1.01), ({"phone": "9876543210"}, {}, "phone", 0.95, 1.01),
    ({"phone": "876543210"}, {}, "phone", 0.94, 0.96), ({"phone": "76543210"}, {}, "phone", 0.89, 0.91), ({"phone": "6543210"}, {}, "phone", 0.84, 0.86),
    ({"phone": "543210"}, {}, "overall", 0.9, 1.01), ({"phone": "9876543211"}, {}, "phone", 0.0, 0.949), ({"address": "Flat B12/3, Gandhi St. Near MG Rd"}, {}, "address", 0.9, 1.01),
    ({"address": "Gandhi Street MG Road"}, {}, "address", 0.9, 1.01), ({"address": "B12 Gandhi Street"}, {}, "address", 0.9, 1.01), ({"address": "Gandhi St MG"}, {}, "address", 0.85, 1.01),
    ({"dob": "19 Apr 2001"}, {}, "dob", 1.0, 1.0), ({"dob": "20/04/2001"}, {}, "dob", 0.0, 0.0), ({"dob": "19/04/1990"}, {}, "dob", 1.0, 1.0), ({"gender": "Man"}, {}, "gender", 1.0, 1.0),
    ({}, {}, "overall", 0.99, 1.0), ({"name": "Rm K", "address": "G St", "phone": "543210"}, {}, "overall", 0.6, 0.9),
    ({"name": "John Smith", "phone": "123456", "gender": "Female", "dob": "01/02/1990", "address": "9 Elm Avenue Springfield"}, {}, "overall", 0.0, 0.6),
]


def test_fixture_ranges(spark):
    docs = spark.createDataFrame([(i, text(**c[0]), None) for i, c in enumerate(CASES)], "application_id long, raw_text string, document_type string")
    forms = spark.createDataFrame([(i, *(USER | c[1]).values()) for i, c in enumerate(CASES)], "application_id long, name string, dob string, phone string, address string, gender string")
    got = {r.application_id: r for r in verify.map_and_verify(docs, forms, F.lit("2026-01-01").cast("date")).collect()}
    for i, (change, _, what, low, high) in enumerate(CASES):
        value = got[i].overall_confidence if what == "overall" else got[i].fields[what]
        assert low <= value <= high, (change, what, value)
    assert got[19].decision == "MATCH" and got[20].decision == "REVIEW" and got[21].decision == "MISMATCH"
    assert {n.split()[0] for n in got[21].notes} >= {"name", "phone", "address", "gender"}


FORM_HI = "प्रथम नाम: रमेश\nअंतिम नाम: कुमार\nलिंग: पुरुष\nजन्म तिथि: 19/04/2001\nउम्र: 24\nपता पंक्ति १: मकान 12\nशहर: दिल्ली\nपिन कोड: 110001\nफोन: 9876543210\nईमेल: a@qmail.com"


def fields_of(spark, raw, kind=None):
    return extract.with_report(extract.extract_fields(spark.createDataFrame([(raw, kind)], "raw_text string, document_type string"))).first()


def test_extraction(spark):
    r = fields_of(spark, FORM_HI)
    assert (r.name, r.gender, r.age, r.address, r.city, r.pincode, r.phone, r.email) == ("रमेश कुमार", "पुरुष", "24", "मकान 12", "दिल्ली", "110001", "9876543210", "a@gmail.com")
    r = fields_of(spark, "City: Bangalore\nPin Code: 560068-12\nmy statement\nName: o'neil\nname: ann")
    assert (r.city, r.state, r.name, r.pincode) == ("Bangalore\nPin Code", "ment\nName", "ann", "560068")
    assert r.address == "Bangalore\nPin Code ment\nName 560068"
    assert r.missing_fields == ["age", "gender", "phone", "email"]
    r = fields_of(spark, None)
    assert r.fields_count == 0 and r.missing_fields == ["name", "age", "gender", "address", "phone", "email"]
    assert fields_of(spark, "First Name\nramesh\nSurname\nkumar", "Voter").name == "Ramesh Kumar"
    assert fields_of(spark, "nothing here", "aadhaar").name is None
    r = fields_of(spark, "Address Line 2: near lake road")
    assert r.address == "Line 2: near lake road near lake road"


def test_documents_restrict_fields_and_skip(spark):
    docs = spark.createDataFrame([(1, text(), "dl"), (2, text(), "birth"), (3, text(age="10"), None)], "application_id long, raw_text string, document_type string")
    forms = spark.createDataFrame([(1, "x", "B12/3 Gandhi St MG Rd", None), (2, "x", "y", ""), (3, "", "", "")], "application_id long, name string, address string, dob string")
    got = {r.application_id: r for r in verify.map_and_verify(docs, forms, F.lit("2026-01-01").cast("date")).collect()}
    assert got[1].decision == "MATCH" and got[1].doc_name is None
    assert (got[2].overall_confidence, got[2].decision, got[2].fields, got[2].notes) == (0.75, "REVIEW", None, [verify.SKIPPED])
    assert got[3].notes == [verify.SKIPPED, "age_mismatch(derived=24, stated=10)"]


def test_weights_and_keys(spark):
    with pytest.raises(ValueError):
        verify.checked_weights({"email": 1.0})
    assert verify.checked_weights({}) is verify.WEIGHTS
    df = spark.createDataFrame([({"Full_Name": "a", "NAME": "b", "phone_no": "1", "x": "y"},)], "m map<string,string>")
    assert df.select(verify.canonical_keys(F.col("m"), lower=True).alias("m")).first().m == {"name": "b", "phone": "1", "x": "y"}


def test_gate_and_batches(spark):
    rows = spark.createDataFrame([(0.9, None), (0.7, [1.0]), (None, [0.9, 0.5]), (None, None), (None, [0.8])], "o double, f array<double>")
    assert [r.p for r in rows.select(register.passes(F.col("o"), F.col("f"), 0.8).alias("p")).collect()] == [True, False, False, True, True]
    files = spark.createDataFrame([("b", 0, "/t/a.pdf", None), ("b", 1, "c.png", "broken"), ("b", 2, "d.png", None)], "batch_id string, pos int, file string, error string")
    forms = spark.createDataFrame([("b", 0, "form")], "batch_id string, pos int, form string")
    got = {r.pos: r for r in register.batch_rows(files, forms).collect()}
    assert (got[0].upload, got[0].form, got[1].status, got[2].form) == ("a.pdf", "form", "error", None)
    assert got[0].registration_id.startswith("PRE") and len(got[0].registration_id) == 13 and got[1].registration_id is None
    counts = register.batch_counts(register.batch_rows(files, forms)).first()
    assert (counts.total_files, counts.successful, counts.failed) == (3, 2, 1)


def test_line_fold():
    got = ocrlines.normal_lines(["First Name", "Ramesh", "SURNAME： Kumar", "Sex", "M", "my age is 24", "31 years", "Gender - f", "Address: 12 MG Road", "  ", "ab", "noise line", "noise line", "हिंदी पंक्ति"])
    assert got == ["First Name: Ramesh", "Last Name: Kumar", "Gender: Male", "Age: 31", "Gender: Female", "Address: 12 MG Road", "noise line"]


def test_review(spark):
    rows = spark.createDataFrame([("2001-04-19", "04/19/2001"), ("19/04/2001", "04/19/2001"), ("2001-04-19", "2001-04-20"), ("x", "2001-04-20")], "a string, b string")
    assert [r.c for r in rows.select(review.edited_dob_confidence(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 1.0, 0.55, 0.6]
    m = spark.createDataFrame([({"Email": "", "EMAIL": "id: a@b", "x": "1"},)], "m map<string,string>").select(review.merged_keys(F.col("m")).alias("m")).first().m
    assert m == {"email": "id: a@b", "x": "1"}
    shown = spark.createDataFrame([({"x": "1", "STATE": " ", "state": "KA", "email": "id: a@b", "Name": "A"},)], "m map<string,string>").select(review.labelled_lines(F.col("m")).alias("l")).first().l
    assert shown == ["Name: A", "State: KA", "Email: a@b", "x: 1"]
    slots = review.shown_slots(spark.createDataFrame([("dob",), ("none",), ("name",)], "slot string")).orderBy("place").collect()
    assert [(r.slot, r.place) for r in slots] == [("name", 1), ("dob", 3)]
    form = spark.createDataFrame([("A", " ", "2001-02-30", "male", "a@b", "1", "x")], "first_name string, last_name string, dob string, gender string, email string, phone string, address string")
    assert form.select(review.form_problems().alias("p")).first().p == ["last_name", "dob", "gender"]


def test_files_and_recogniser(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"First Name: A\nzz")
    (tmp_path / "b.PDF").write_bytes(b"one page\x0csecond page")
    (tmp_path / "c.docx").write_bytes(b"x")
    (tmp_path / "bad.png").write_bytes(b"\xff")

    def make_reader(lang):
        return lambda content, how: [p.split("\n") for p in content.decode().split("\x0c")]

    got = {r.path.rsplit("/", 1)[1]: r for r in sources.extract_text(sources.read_files(spark, str(tmp_path)), make_reader).collect()}
    assert got["a.png"].raw_text == "First Name: A"
    assert got["b.PDF"].raw_text == "--- PAGE 1 ---\none page\n\n--- PAGE 2 ---\nsecond page"
    assert "unsupported" in got["c.docx"].error and got["bad.png"].error
    assert sources.recognised_texts([[[[[0, 0]], (" a ", 0.9)], [[[0, 1]], "b"]], [[[[0, 0]], ("", 1)]]]) == ["a", "b"]
    assert sources.recognised_texts([{"res": {"rec_texts": ["x", " "]}}]) == ["x"]


def test_files_to_records(spark):
    rows = [("a.pdf", b"First Name: Ann\nAge: 30", "pdf"), ("b.png", b"\xff", "image"), ("b.png", b"Sex\nF", "image")]

    def make_reader(lang):
        return lambda content, how: [content.decode().split("\n")]

    got = sorted((r.path, r.name, r.age, r.gender, r.error is None, r.fields_count) for r in sources.extract_and_map(spark.createDataFrame(rows[:2], "path string, content binary, handler string"), make_reader).collect())
    assert got == [("a.pdf", "Ann", "30", None, True, 2), ("b.png", None, None, None, False, 0)]


def test_sinks_and_stream(spark, tmp_path):
    from fieldloom.streaming import ingest

    rows = [{"application_id": i, "raw_text": text(), "document_type": None} for i in range(3)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.json").write_text("\n".join(json.dumps(r) for r in rows))
    forms = spark.createDataFrame([(i, *USER.values()) for i in range(3)], "application_id long, name string, dob string, phone string, address string, gender string")
    q = ingest.start_verification(ingest.text_stream(spark, str(tmp_path / "in")), forms, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = spark.read.json(str(tmp_path / "out"))
    assert got.where("ts < '2020'").count() == 0
    assert got.count() == 3 and {r.decision for r in got.select("response.decision").collect()} == {"MATCH"}
    pairs = verify.verify(verify.pair(spark.createDataFrame([(1, *USER.values())], "application_id long, name string, dob string, phone string, address string, gender string"), forms))
    for _ in range(2):
        sinks.append_jsonl(pairs, str(tmp_path / "log"))
        sinks.append_csv(pairs, str(tmp_path / "csv"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    csv = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert csv.count() == 2 and csv.columns[:3] == ["overall_confidence", "decision", "f_name"]


def test_labelled_lines_merge_a_record_once(spark):
    assert str(review.labelled_lines(F.col("record"))).lower().count("transform_values") == 1
