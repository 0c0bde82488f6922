"""Recognised lines to normal lines: labels found fuzzily, values from the same line or the next, no repeats.

A value may lie on the line after its label, so an array of lines is folded in one pass of a vectorised UDF. What a line
says by itself is kept by its text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.dictionaries import LINE_PHRASES, LINE_SCORE, LINE_STARTS
from ..functions.fuzzy import PhraseIndex
from .labels import Reading, with_values

_PHRASES = [(label, p) for label, ps in LINE_PHRASES.items() for p in ps]
_INDEX = PhraseIndex([p for _, p in _PHRASES], LINE_SCORE)
_START = re.compile(LINE_STARTS, re.IGNORECASE)
_FOLD = str.maketrans({"—": "-", "–": "-", "：": ":"})
# Labels that may open a line with a value right behind.
_INLINE = [
    ("First Name", r"first\s*name|given\s*name|forename"), ("Middle Name", r"middle\s*name"), ("Last Name", r"last\s*name|surname|family\s*name"),
    ("Gender", "gender|sex"), ("Address", r"address|addr|residential\s*address|permanent\s*address|current\s*address|correspondence\s*address"), ("Age", "age"),
]
_INLINE_RE = [(label, re.compile(rf"\s*(?:{p})\s*[:\-]?\s*(.+)$", re.IGNORECASE)) for label, p in _INLINE]


def fold_punctuation(line: str) -> str:
    return line.translate(_FOLD)


def canonical(label: str, value: str) -> str | None:
    """Value of a label in its usual form; None for an age without a number where one is needed."""
    if label == "Gender":
        return {"m": "Male", "male": "Male", "f": "Female", "female": "Female"}.get(value.lower(), value)
    if label == "Age":
        m = re.search(r"\b(\d{1,3})\b", value)
        return m.group(1) if m else None
    return value


def _shown(label: str, value: str | None) -> str | None:
    value = (value or "").strip().strip("-:").strip()
    return f"{label}: {value}" if value else None


def _inline(line: str, own: str) -> str | None:
    """A line without a fuzzy label as it is kept: one that opens with a label in its form, another as it is, noise not at all."""
    for label, regex in _INLINE_RE:
        m = regex.match(line)
        value = canonical(label, m.group(1).strip()) if m else None
        if value is not None:
            return _shown(label, value)
    return own if len(own) >= 3 and re.search("[A-Za-z0-9]", own) else None


@lru_cache(maxsize=100_000)
def read_line(raw: str | None) -> Reading:
    own = (raw or "").strip()
    line = fold_punctuation(own)
    at = _INDEX.best(line.lower()) if own else None
    if at is None:
        return Reading(own, closed=bool(_START.match(line)), other=_inline(line, own) if own else None)
    label, phrase = _PHRASES[at]
    mark = re.search("[:-]", line)
    behind = mark.end() if mark else len(phrase) if line.lower().startswith(phrase) else len(line)
    return Reading(own, label, line[behind:].strip(), bool(_START.match(line)), _inline(line, own))


def _reader(lines: list[str | None]):
    """read_line() of a document's lines; long ones, which seldom come again elsewhere, are kept for the document alone."""
    long = {x: read_line.__wrapped__(x) for x in lines if x is not None and len(x) > PhraseIndex.LONGEST}
    return lambda x: long[x] if x in long else read_line(x)


def normal_lines(raw: list[str | None]) -> list[str]:
    """Labels with their values in usual form and other lines as they are, each once, where it first comes."""
    kept = (_shown(r.label, canonical(r.label, v) or v) if v else r.other for r, v in with_values(map(_reader(raw), raw)))
    return list(dict.fromkeys(k for k in kept if k))


#: Rows that are Python objects at a time.
_ROWS = 256


@F.arrow_udf(ArrayType(StringType()))
def normalise_lines(lines: pa.Array) -> pa.Array:
    done = [pa.array([None if x is None else normal_lines(x) for x in lines.slice(at, _ROWS).to_pylist()], pa.list_(pa.string())) for at in range(0, len(lines), _ROWS)]
    return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.string()))
