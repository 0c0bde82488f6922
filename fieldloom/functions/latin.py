"""Any script to Latin letters, character by character, after the letters' names.

Letters of the Brahmic scripts are named alike in Unicode: a consonant by its sound and an inherent A, a vowel, a vowel sign, a
virama. So one rule reads them all, and the fold over a word, which knows where an inherent vowel is heard, is the same for
each. Hangul syllables and kana carry their sound in their names, too; for a few alphabets whose letters have names of their
own, there are tables. Accents go. Characters without a sound of their own (ideographs) stay.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Sounds of consonants whose Unicode name is spelt otherwise, without the A.
_STEMS = {"C": "ch", "CH": "chh", "NG": "n", "NY": "n", "SS": "sh", "NGG": "g"}
# Sounds of vowels by the last word of their Unicode name; the others are their first letter.
_VOWELS = {"AI": "ai", "AU": "au", "R": "ri", "RR": "ri", "L": "li", "LL": "li"}
# Small letters of alphabets whose letters have names, with their sounds.
_LETTERS = dict(
    zip(
        "а б в г д е ж з и к л м н о п р с т у ф х ц ч ш щ ъ ы ь э ю я і є ґ ђ ј љ њ ћ џ".split(),
        "a b v g d e zh z i k l m n o p r s t u f kh ts ch sh shch \" y ' e iu ia i ie g dj j lj nj tsh dz".split(),
        strict=True,
    )
)
_LETTERS |= dict(zip("α β γ δ ε ζ η θ ι κ λ μ ν ξ ο π ρ σ ς τ υ φ χ ψ ω".split(), "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split(), strict=True))
_LETTERS |= dict(
    zip(
        "ا ب ت ث ج ح خ د ذ ر ز س ش ص ض ط ظ ع غ ف ق ك ل م ن ه و ي ى ة پ چ ژ گ ک ی ہ ے ں ٹ ڈ ڑ ھ".split(),
        "a b t th j h kh d dh r z s sh s d t z ` gh f q k l m n h w y a h p ch zh g k y h e n t d r h".split(),
        strict=True,
    )
)
_LETTERS |= dict(zip("א ב ג ד ה ו ז ח ט י כ ך ל מ ם נ ן ס ע פ ף צ ץ ק ר ש ת".split(), "' b g d h w z h t y k k l m m n n s ` p p ts ts q r sh t".split(), strict=True))
_LETTERS |= {"ß": "ss", "ð": "d", "þ": "th", "ŋ": "ng", "ı": "i", "ə": "e"}
# Typographic marks, and signs of currencies.
_MARKS = {
    "‘": "'", "’": "'", "‚": ",", "‛": "'", "′": "'", "“": '"', "”": '"', "„": '"', "″": '"', "«": "<<", "»": ">>", "‹": "<", "›": ">", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "--", "―": "--",
    "−": "-", "•": "*", "·": "*", "।": ".", "॥": ".", "،": ",", "؛": ";", "؟": "?", "₹": "Rs", "€": "EUR", "£": "PS", "×": "x", "÷": "/", "№": "No", "ء": "", "ـ": "",
}

_INDIC = re.compile(r"(DEVANAGARI|BENGALI|GURMUKHI|GUJARATI|ORIYA|TAMIL|TELUGU|KANNADA|MALAYALAM|SINHALA) (LETTER|VOWEL SIGN|SIGN|AU LENGTH MARK|TIPPI|ADDAK)? ?(.*)")
_LATIN = re.compile(r"LATIN (SMALL|CAPITAL) (?:LETTER|LIGATURE) ([A-Z]{1,2})(?: WITH .*)?")
_SOUNDING = re.compile(r"(?:HANGUL SYLLABLE|(?:HIRAGANA|KATAKANA) LETTER(?: SMALL)?) ([A-Z]+)")


def _indic(name: str) -> tuple[str, str] | None:
    """(kind, sound): a consonant without its vowel, a vowel, a sign that takes its place, the virama, or a mark."""
    m = _INDIC.fullmatch(name)
    if not m:
        return None
    _, kind, rest = m.groups()
    last = rest.split(" ")[-1]
    if kind == "LETTER" and last.endswith("A") and len(last) > 1 and last != "AA":
        stem = last[:-1]
        sound = _STEMS.get(stem) or re.sub(r"(.)\1+", r"\1", stem).lower()
        return ("dead" if "KHANDA" in rest else "consonant"), sound
    if kind == "LETTER" and "CHILLU" in rest:
        return "dead", last[0].lower()
    if kind in ("LETTER", "VOWEL SIGN"):
        return ("vowel" if kind == "LETTER" else "sign"), _VOWELS.get(last, last[0].lower())
    if kind == "TIPPI" or kind == "SIGN" and last in ("ANUSVARA", "ANUSVARAYA", "CANDRABINDU", "BINDI"):
        return "mark", "n"
    if kind == "SIGN" and last in ("VISARGA", "VISARGAYA"):
        return "mark", "h"
    if kind == "SIGN" and last in ("VIRAMA", "AL-LAKUNA"):
        return "virama", ""
    return None if rest.startswith("DIGIT") else ("mark", "")


@lru_cache(maxsize=20_000)
def read(ch: str) -> tuple[str, str]:
    """(kind, sound) of a character; kind is "" outside the Brahmic scripts."""
    if ch.isascii():
        return "", ch if ch.isprintable() else ""
    if ch in _MARKS:
        return "", _MARKS[ch]
    if unicodedata.category(ch)[0] == "C":
        return "", ""
    number = unicodedata.decimal(ch, None)
    if number is not None:
        return "", str(number)
    name = unicodedata.name(ch, "")
    indic = _indic(name)
    if indic:
        return indic
    sounding = _SOUNDING.fullmatch(name)
    if sounding:
        return "", sounding[1].lower()
    latin = _LATIN.fullmatch(name)
    small = _LETTERS.get(ch.lower()) or (latin and latin[2].lower())
    if small:
        return "", small.capitalize() if ch != ch.lower() else small
    parts = unicodedata.normalize("NFKD", ch)
    if parts != ch:
        return "", "".join(read(p)[1] for p in parts)
    return "", "" if unicodedata.combining(ch) else ch


def to_latin(text: str) -> str:
    """Latin letters; a consonant of a Brahmic script keeps its inherent vowel, but for a word's last after another letter."""
    read_all = [read(ch) for ch in unicodedata.normalize("NFC", text)]
    read_all = [r for r in read_all if r != ("mark", "")]  # a nukta changes no sound here
    out = []
    for i, (kind, sound) in enumerate(read_all):
        out.append(sound)
        if kind == "consonant":
            before = read_all[i - 1][0] if i else ""
            after = read_all[i + 1][0] if i + 1 < len(read_all) else ""
            if after not in ("sign", "virama") and (after or not before or before == "virama"):
                out.append("a")
    return "".join(out)
