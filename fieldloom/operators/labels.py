"""Labels and values that lie on one line or on two: the fold that recognised lines and name documents share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True, slots=True)
class Reading:
    """What one line says by itself: a label, a value behind it, whether it can be no other label's value, and what else it is."""

    text: str = ""
    label: Any = None
    value: str = ""
    closed: bool = False
    other: str | None = None


END = Reading()


def with_values(readings: Iterable[Reading]) -> Iterator[tuple[Reading, str]]:
    """Each line that says anything, with the value of its label: its own, or the whole next line, which then says nothing itself.

    One state: a label that waits for its value. The next line ends the wait in any case; an empty one, or one that begins
    with a label, leaves it without.
    """
    waiting = None
    for now in (*readings, END):
        if waiting is not None:
            takes = bool(now.text) and not now.closed
            yield waiting, now.text if takes else ""
            waiting = None
            if takes:
                continue
        if now.label is not None and not now.value:
            waiting = now
        elif now.text:
            yield now, now.value
