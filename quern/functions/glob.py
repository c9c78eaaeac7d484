"""GLOB patterns as regular expressions."""

from __future__ import annotations

import re


def glob_regex(pattern: str) -> str:
    """A regular expression, for whole strings, of a GLOB pattern: ``*``, ``?`` and ``[...]`` with ``^`` for all others."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] not in ("^",) else i + 3)
            if end < 0:
                return "(?!)"  # a class that never ends matches nothing
            inside = pattern[i + 1 : end]
            negated = inside.startswith("^")
            body = inside[1:] if negated else inside
            out.append("[" + "^" * negated + re.sub(r"([\\\[\]^&~])", r"\\\1", body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "^(?s:" + "".join(out) + r")\z"


def glob_match(pattern: str | None, value: str | None) -> bool | None:
    if pattern is None or value is None:
        return None
    return re.match(glob_regex(pattern).replace(r"\z", r"\Z"), value) is not None


def characters(*codes: int | None) -> str:
    return "".join(chr(c) for c in codes if c is not None)
