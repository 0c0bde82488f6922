"""Word lists, lookup tables and patterns that results depend on."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token expansions of addresses. Letters with a nukta occur as one code point and as two.
EXPANSIONS = {
    "st": "street", "rd": "road", "ave": "avenue", "av": "avenue", "ln": "lane", "ct": "court", "cir": "circle", "dr": "drive", "pl": "place",
    "pkwy": "parkway", "hwy": "highway", "bldg": "building", "blk": "block", "apt": "apartment", "flat": "flat", "ste": "suite", "fl": "floor",
    "flr": "floor", "twr": "tower", "ph": "phase", "sec": "sector", "no": "number", "hno": "house number", "po": "post office",
    "ps": "police station", "stn": "station", "dist": "district", "tal": "taluk", "teh": "tehsil", "nr": "near",
    "rod": "road", "marg": "road", "sadak": "road", "gali": "lane", "makan": "house", "bhavan": "building", "tavar": "tower",
    "apartment": "apartment", "phlait": "flat", "najdik": "near", "nazdik": "near", "paas": "near",
    "रोड": "road", "मार्ग": "road", "सड़क": "road", "सड़क": "road", "सडक": "road", "गली": "lane", "मकान": "house", "भवन": "building", "टावर": "tower",
    "अपार्टमेंट": "apartment", "फ़्लैट": "flat", "फ्लैट": "flat", "नजदीक": "near", "नज़दीक": "near", "पास": "near",
}

# Tokens left out of names and addresses.
STOP_TOKENS = (
    "near nearby opposite opp behind beside by at the in next to of and country usa india के और में का की पर को से तक"
).split()

# Months by their first three letters.
MONTHS = dict(zip("jan feb mar apr may jun jul aug sep oct nov dec".split(), range(1, 13), strict=True))

# Gender words.
GENDERS = {
    "m": "male", "male": "male", "man": "male", "boy": "male", "f": "female", "female": "female", "woman": "female", "girl": "female",
    "other": "other", "others": "other", "nb": "other", "non-binary": "other", "nonbinary": "other",
    "पुरुष": "male", "आदमी": "male", "लड़का": "male", "लड़का": "male", "बालक": "male", "महिला": "female", "स्त्री": "female", "नारी": "female",
    "लड़की": "female", "लड़की": "female", "अन्य": "other", "दूसरे": "other", "purush": "male", "aadmi": "male", "ladka": "male", "balak": "male",
    "mahila": "female", "stree": "female", "naari": "female", "nari": "female", "ladki": "female", "anya": "other", "dusre": "other",
}

# Other names of form keys.
KEY_NAMES = {
    "full_name": "name", "given_name": "name", "first_name": "name", "last_name": "surname", "mobile": "phone", "phone_no": "phone",
    "phoneNumber": "phone", "phoneNumberE164": "phone", "date_of_birth": "dob", "birth_date": "dob",
}

# Fields that a kind of document vouches for; others are not restricted.
DOCUMENT_FIELDS = {
    "aadhar": ["name"], "voter": ["name"], "dl": ["address", "city", "state", "pincode"], "passport": ["address", "city", "state", "pincode"],
    "birth": ["dob"], "slc": ["dob"],
}
NAME_DOCUMENTS = ["aadhar", "aadhaar", "voter"]

FIELDS = ["name", "gender", "dob", "age", "address", "city", "state", "pincode", "phone", "email"]
EXPECTED = ["name", "age", "gender", "address", "phone", "email"]
SCORED = ["name", "dob", "phone", "address", "gender"]
# Weights of the scored fields, in the order of notes.
WEIGHTS = {"name": 0.35, "dob": 0.30, "phone": 0.15, "address": 0.15, "gender": 0.05}

_GAP = r"[:\s]*"
_REST2, _REST3, _REST5, _REST4_10 = r"[^\n]{2,}", r"[^\n]{3,}", r"[^\n]{5,}", r"[^\n]{4,10}"
_DATE = r"[0-9]{1,2}[\-/][0-9]{1,2}[\-/][0-9]{2,4}"
_PHONE, _MAIL = r"[+0-9\s\-().]{7,}", r"[a-zA-Z0-9._%+-@]{5,}"

# Fixed values: (label, value) patterns of each field, first match wins. Between them stand colons and white space, but where a third part says otherwise.
LABELLED = {
    "first_name": [(r"(?:प्रथम|फर्स्ट)\s*नाम", _REST2), (r"पहला\s*नाम", _REST2), (r"(?:FIRST|FUEST)\s*(?:NAME|MOUNT)", "[A-Za-z]{2,}"), ("First Name", "[A-Za-z]{2,}")],
    "middle_name": [(r"मध्य\s*नाम", _REST2), (r"बीच\s*का\s*नाम", _REST2), (r"MIDDLE\s*NAME", "[A-Za-z]{2,}"), ("Middle Name", "[A-Za-z]{2,}")],
    "last_name": [(r"अंतिम\s*नाम", _REST2), (r"आखिरी\s*नाम", _REST2), (r"LAST\s*NAME", "[A-Za-z]{2,}"), ("Last Name", "[A-Za-z]{2,}")],
    "gender": [("लिंग", _REST4_10), ("जेंडर", _REST4_10), ("(?:Gender|Chender)", "[A-Za-z]{4,8}"), ("Sex", "[A-Za-z]{4,8}")],
    "dob": [("(?:जन्म तिथि|जन्मतिथि)", _DATE), (r"जन्म\s*दिनांक", _DATE), ("(?:Date of birth|DOB)", _DATE), ("Birth Date", _DATE)],
    "age": [("उम्र", r"\d{1,3}"), ("आयु", r"\d{1,3}"), ("Age", r"\d{1,3}"), ("Years", r"\d{1,3}")],
    "address_line1": [
        (r"पता\s*पंक्ति\s*१", _REST5), (r"एड्रेस\s*लाइन\s*१", _REST5), (r"(?:ADDRESS|ADDREAS)\s*LINE?\s*1", _REST5), ("Address Line 1", _REST5),
        ("Address", _REST5, r"\s*[:\-]?\s*"),
    ],
    "address_line2": [(r"पता\s*पंक्ति\s*२", _REST5), (r"एड्रेस\s*लाइन\s*२", _REST5), (r"(?:ADDRESS|ADDREAS)\s*LINE?\s*2", _REST5), ("Address Line 2", _REST5)],
    "city": [("शहर", _REST3), ("सिटी", _REST3), ("City", r"[A-Za-z\s]{3,}")],
    "state": [("राज्य", _REST3), ("स्टेट", _REST3), ("State", r"[A-Za-z\s]{3,}")],
    "pincode": [
        ("(?:पिन|पिनकोड)", r"\d{4,8}"), (r"पिन\s*कोड", r"\d{4,8}"), (r"(?:PIN|Prin)\s*CODE", r"\d{4,8}"), ("Pincode", r"\d{4,8}"),
        (r"ZIP\s*CODE", r"\d{4,8}"), ("Zipcode", r"\d{4,8}"), ("Zip", r"\d{4,8}"),
    ],
    "phone": [("(?:फोन|टेलीफोन)", _PHONE), ("मोबाइल", _PHONE), (r"Phone\s*(?:number)?", _PHONE), ("Mobile", _PHONE)],
    "email": [("(?:ईमेल|इमेल)", _MAIL), ("ई-मेल", _MAIL), ("(?:EMAIL|EMAIL ID)", _MAIL), ("E-?mail", _MAIL)],
}

# Labels that a line may begin with, by field.
LINE_LABELS = {
    "name": ["name", "full name", "given name"], "first_name": ["first name", "firstname"], "middle_name": ["middle name", "middlename"],
    "last_name": ["last name", "lastname", "surname"], "address": ["address", "addr"], "city": ["city"], "state": ["state"],
    "pincode": ["pincode", "pin code", "pin", "zipcode", "zip code", "zip"], "phone": ["phone", "phone number", "mobile"],
    "email": ["email", "email id", "e-mail"], "gender": ["gender", "sex"], "dob": ["date of birth", "dob", "birth date"], "age": ["age", "years"],
}

# Label phrases looked for fuzzily, in order.
NAME_PHRASES = ["first name", "middle name", "last name", "given name", "surname", "family name"]
PHRASE_PARTS = {
    "first name": "first_name", "given name": "first_name", "middle name": "middle_name", "last name": "last_name", "surname": "last_name", "family name": "last_name",
}
LINE_PHRASES = {
    "First Name": ["first name", "given name", "forename"], "Middle Name": ["middle name"], "Last Name": ["last name", "surname", "family name"],
    "Gender": ["gender", "sex"], "Address": ["address", "residential address", "permanent address", "current address", "correspondence address"], "Age": ["age"],
}
NAME_SCORE, LINE_SCORE = 80, 85
# What begins a line that is a label, not a value.
NAME_STARTS = r"\s*(first\s*name|middle\s*name|last\s*name|surname|family\s*name|gender|sex|address|addr|city|state|age|dob|date\s*of\s*birth|phone|mobile|email|e-?mail)\b"
LINE_STARTS = r"\s*(first\s*name|middle\s*name|last\s*name|surname|family\s*name|gender|sex|address|age)\b"


def labelled_value(label: str, value: str, gap: str = _GAP) -> str:
    """Pattern of a label at the start of a word, and the value behind it."""
    return rf"\b{label}{gap}({value})"


def lookup(table: dict, key: Column) -> Column:
    """Value of key in a small fixed table, null if it isn't there."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)
