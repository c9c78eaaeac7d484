"""Texts cut into the matches of a byte-level BPE's pattern, with work shared between equal words.

In this pattern a space that precedes a non-space always begins a match, so a text may be cut
before such spaces and each part matched by itself. Parts repeat, which makes a cache of
finished parts serve most of a text; the pattern runs only on parts that are new.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: A space before white space does not begin a match; such texts are cut elsewhere.
SPACED = re.compile(r" (?=\s)")
CUTS = re.compile(r"(?= \S)")


def parts(text: str) -> Iterable[str]:
    """Parts of ``text``, in order, that can be matched by themselves; all but the first begin with a space."""
    if SPACED.search(text):
        return filter(None, CUTS.split(text))
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


class PartCache(dict):
    """part -> what ``make`` gives for it. Holds at most ``most`` parts of at most ``longest`` characters;
    parts beyond are made each time, so the bound costs time only."""

    def __init__(self, make: Callable[[str], object], most: int = 300_000, longest: int = 48) -> None:
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, part: str) -> object:
        made = self.make(part)
        if len(self) < self.most and len(part) <= self.longest:
            self[part] = made
        return made
