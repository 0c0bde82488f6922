import random
import re

import pytest

import pandas as pd

from fieldloom.sources import documents as sources
from fieldloom.functions import dictionaries as D
from fieldloom.functions.scan import beginnings
from fieldloom.operators import extract, ocrlines
from fieldloom.operators.labels import Reading, with_values

LABELS = [
    "FIRST NAME", "FUEST MOUNT", "First Name", "Firſt name", "firſt name", "City", "CITY", "State", "ſtate", "Pin Code", "PIN  CODE", "Prin\tcode", "pincode", "Zip", "Zipcode", "zip code", "Phone number", "Phone",
    "phone\nnumber", "Mobile", "E-mail", "Email", "EMAIL ID", "Emaİl", "emaıl", "शहर", "सिटी", "राज्य", "पिन", "पिनकोड", "पिन कोड", "प्रथम नाम", "पहला  नाम", "मध्य नाम", "लिंग", "उम्र", "आयु", "जन्म तिथि", "जन्मतिथि", "जन्म  दिनांक",
    "पता पंक्ति १", "पता पंक्ति २", "Address Line 1", "ADDREAS LIN 2", "Address", "DOB", "Date of birth", "Birth Date", "Age", "Years", "Sex", "Chender", "surname", "full name", "name", "ई-मेल", "मोबाइल", "फोन",
]
VALUES = ["Bangalore", "560068", "12-03-1995", "+91 99876 59110", "a@qmail.com", "राजेश कुमार", "पुरुष", "24", "x", "Female", "१२३, एमजी रोड", "", "Road#1, Street #2"]


def every_pattern(text):
    """Each pattern searched for by itself."""
    out = {}
    for f, own in D.LABELLED.items():
        hits = [m for p in own if (m := re.search(D.labelled_value(*p), text, re.IGNORECASE))]
        if hits:
            out[f"p_{f}"] = hits[0][1].strip()
    for line in map(str.strip, text.splitlines()):
        for f, own in D.LINE_LABELS.items() if len(line) >= 3 else ():
            hits = [m[1].strip() for lab in own if (m := re.match(rf"{re.escape(lab)}\s*[:\-]?\s*(.+)$", line, re.IGNORECASE)) and m[1].strip()]
            if hits:
                out[f"l_{f}"] = hits[0]
    return out


def test_one_pass_finds_what_every_pattern_does():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(["\n", "\n", "\n  ", "x", " ", "\r\n", "\x85", "_"]) + rng.choice(LABELS) + rng.choice([": ", ":", " ", "\n", "-", " - ", "", ":\n"]) + rng.choice(VALUES) for _ in range(rng.randint(0, 9)))
        assert extract._SCAN.values(text) == every_pattern(text), text


def test_beginnings():
    assert beginnings("E-?mail") == {"email", "e-mail"}
    assert beginnings(r"(?:PIN|Prin)\s*CODE") == {"pin", "prin"}
    assert beginnings(r"Phone\s*(?:number)?") == {"phone"}


HINDI = "\n    प्रथम नाम: राजेश\n    मध्य नाम: कुमार\n    अंतिम नाम: शर्मा\n    लिंग: पुरुष\n    जन्म तिथि: 15-03-1995\n    पता पंक्ति १: १२३, एमजी रोड\n    शहर: दिल्ली\n    पिनकोड: ११०००१\n    फोन: ९८७६५४३२१०\n    ईमेल: rajes@example.com\n"
ENGLISH = "\n    FIRST NAME: Abigail\n    MIDDLE NAME: Grace  \n    LAST NAME: Summer\n    Gender: Female\n    Date of birth: 27-09-2000\n    Address Line1: Road#1, Street #2\n    City: Bangalore\n    Pin Code: 560068\n    Phone number: 9987659110\n    Email Id: abigail@gmail.com\n"


def test_forms_in_both_languages(spark):
    got = extract.extract_fields(spark.createDataFrame([(1, HINDI), (2, ENGLISH), (3, None), (4, ""), (5, "word " * 50_000)], "k int, raw_text string"), kind=None).orderBy("k").collect()
    assert got[0].name == "राजेश कुमार शर्मा" and got[0].gender == "पुरुष" and got[0].dob == "15-03-1995" and got[0].address == "१२३, एमजी रोड" and got[0].city == "दिल्ली" and got[0].email == "rajes@example.com"
    assert got[1].name == "Abigail Grace Summer" and got[1].address == "Road#1, Street #2" and got[1].pincode == "560068" and got[1].phone == "9987659110" and got[1].email == "abigail@gmail.com"
    assert all(v is None for r in got[2:] for v in (r.name, r.address, r.phone, r.age))


@pytest.mark.parametrize(
    "lines, want",
    [
        (["First Name", "Ramesh"], ["First Name: Ramesh"]), (["First Name", "", "Ramesh"], ["First Name", "Ramesh"]), (["First Name", None, "x"], ["First Name"]),
        (["First Name", "Surname: K", "x y"], ["First Name", "Last Name: K", "x y"]), (["Sex", "m", "Gender: female", "SEX - F"], ["Gender: Male", "Gender: Female"]), (["Age", "none"], ["Age: none"]),
        (["addr 12 Road"], ["Address: 12 Road"]), (["Gender", "Age"], ["Gender", "Age"]), (["First Name: -"], []), ([], []), (["Middle Name: K", "Middle Name: K", "ab", "row"], ["Middle Name: K", "row"]),
    ],
)
def test_lines_with_values(lines, want):
    assert ocrlines.normal_lines(lines) == want


def test_the_next_line_is_taken_once():
    readings = [Reading("a", "A"), Reading("b"), Reading("c", "C"), Reading(""), Reading("d", "D"), Reading("e", "E", "v", True), Reading("f", "F")]
    assert [(r.text, v) for r, v in with_values(readings)] == [("a", "b"), ("c", ""), ("d", ""), ("e", "v"), ("f", "")]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Name: ravi das", "Ravi Das"), ("Name: a b\nFirst Name\nravi\nSurname: das", "Ravi"), ("surname - das\nFirst Name - ravi", "Ravi Das"), ("Frst Name: ravi\nmidle name - k\nfamily name\nGender: x", "K"), ("FUEST MOUNT ravi", "Ravi"),
        ("nothing", None), ("", None), ("Given name\nAddress: 1", None), ("name x\nname y", "Name Y"), ("Name: x\nName: y", "Y"),
    ],
)
def test_name_documents(text, want):
    assert extract.name_of(text) == want


def test_recognised_documents_leave_a_task_together():
    class Docs:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):  # noqa: N802
            return run

    run = sources.recognise(Docs(), lambda lang: lambda content, how: [content.decode().split("\n"), [" "]])
    batch = pd.DataFrame({"path": ["a", "b", "c"], "content": [b"x\n \ny", b"\xff", b"z"], "handler": ["pdf"] * 3})
    frames = list(run(iter([batch, batch.head(0)])))
    assert len(frames) == 1 and list(frames[0]["path"]) == ["a", "a", "b", "c", "c"] and list(frames[0]["lines"]) == [["x", "y"], [], [], ["z"], []]
    assert list(frames[0]["page_no"]) == [1, 2, 1, 1, 2] and [e is None for e in frames[0]["error"]] == [True, True, False, True, True]


def test_long_lines_are_not_kept():
    long = "first name " + "of a very long line of prose " * 5
    before = ocrlines.read_line.cache_info().currsize, len(ocrlines._INDEX.known)
    assert ocrlines.normal_lines([long, long, None]) == ocrlines.normal_lines([long]) and len(ocrlines.normal_lines([long])) == 1
    ocrlines.read_line(None)
    assert (ocrlines.read_line.cache_info().currsize, len(ocrlines._INDEX.known)) == (before[0] + 1, before[1])
