"""All fields' labels in a text, found in one pass by an automaton over what labels can begin with.

A field's pattern is a label and the value behind it. Only where a label begins is a pattern tried, so a text costs one pass
and a few short matches, however many fields, languages and spellings there are.
"""

from __future__ import annotations

import re
from collections import defaultdict

import ahocorasick

from .dictionaries import LABELLED, LINE_LABELS, labelled_value

#: Letters whose other case has other length or is reached from ASCII letters alone.
_TO_ASCII = str.maketrans({"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"})


def folded(text: str) -> str:
    """Lower case, character by character."""
    return text.lower() if text.isascii() else text.translate(_TO_ASCII).lower()


def beginnings(label: str) -> set[str]:
    """The literal texts, in lower case, that a label's pattern can begin with."""
    group = re.match(r"\(\?:([^()]*)\)", label)
    if group:
        return {folded(x) for x in group[1].split("|")}
    forms = {re.sub(r"([^()\\])\?", keep, label) for keep in (r"\1", "")}
    return {folded(re.match(r"[^\\(\[]+", f)[0]) for f in forms}


class LabelScan:
    """Values by field: of the first of its patterns that matches anywhere, and of the last line that begins with one of its labels."""

    def __init__(self, patterns: dict[str, list[tuple]] = LABELLED, line_labels: dict[str, list[str]] = LINE_LABELS):
        self.patterns = {f: [re.compile(labelled_value(*p), re.IGNORECASE) for p in own] for f, own in patterns.items()}
        self.line_labels = {f: [re.compile(rf"{re.escape(lab)}\s*[:\-]?\s*(.+)$", re.IGNORECASE) for lab in own] for f, own in line_labels.items()}
        found: dict[str, list[tuple]] = defaultdict(list)
        for f, own in patterns.items():
            for order, p in enumerate(own):
                for key in beginnings(p[0]):
                    found[key].append((True, f, order))
        for f, own in line_labels.items():
            for order, lab in enumerate(own):
                found[folded(lab)].append((False, f, order))
        self.automaton = ahocorasick.Automaton()
        for key, entries in found.items():
            self.automaton.add_word(key, (len(key) - 1, entries))
        self.automaton.make_automaton()

    def values(self, text: str) -> dict[str, str]:
        """p_<field> and l_<field>, stripped, for those that the text has."""
        lines, at = {}, 0
        for line in text.splitlines(keepends=True):
            own = line.strip()
            if len(own) >= 3:
                lines[at + line.index(own)] = own
            at += len(line)
        spots: dict[tuple, list[int]] = defaultdict(list)
        begun: dict[tuple, list[int]] = defaultdict(list)
        for end, (reach, entries) in self.automaton.iter(folded(text)):
            start = end - reach
            for anywhere, f, order in entries:
                if anywhere:
                    spots[f, order].append(start)
                elif start in lines:
                    begun[start, f].append(order)
        out = {}
        for f, own in self.patterns.items():
            match = next((m for order, p in enumerate(own) for at in spots.get((f, order), ()) if (m := p.match(text, at))), None)
            if match:
                out[f"p_{f}"] = match[1].strip()
        for (start, f), orders in sorted(begun.items()):
            match = next((m for order in sorted(orders) if (m := self.line_labels[f][order].match(lines[start])) and m[1].strip()), None)
            if match:
                out[f"l_{f}"] = match[1].strip()
        return out
