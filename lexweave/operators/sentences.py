"""Where sentences begin; each kind of source has breaks and abbreviations of its own."""

from __future__ import annotations

import re
import string

IN_WORD = string.ascii_letters + "'"

CLASSES = {"w": "A-Za-z0-9_", "d": "0-9"}


def ascii_classes(pattern: str) -> str:
    """A pattern whose words, digits and word ends are ASCII, as in the patterns' own language; white space stays that of Unicode."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        c, two = pattern[at], pattern[at : at + 2]
        if c == "\\":
            name = two[1:]
            if name in CLASSES:
                two = CLASSES[name] if inside else f"[{CLASSES[name]}]"
            elif name == "b" and not inside:
                two = r"(?a:\b)"
            out.append(two)
            at += 2
            continue
        if c in "[]":
            inside = c == "[" or (inside and pattern[at - 1] == "[")
        out.append(c)
        at += 1
    return "".join(out)


def compiled(pattern: str, flags: int = 0) -> re.Pattern:
    return re.compile(ascii_classes(pattern), flags)


def starts(text: str, breaks: re.Pattern, shortened: set[str], dotted: re.Pattern | None = None) -> list[int]:
    """Ends of the breaks that are none of an abbreviation's, in order; the text's own beginning is left out.

    A break at a line's end always counts. ``dotted`` is what ends in an abbreviation whatever its last word is.
    """
    out = []
    for m in breaks.finditer(text):
        before = text[max(0, m.start() - 12) : m.start()]
        word = before[len(before.rstrip(IN_WORD)) :].lstrip("'")
        short = bool(word) and (word in shortened or bool(dotted and dotted.search(before)))
        if m[0].startswith("\n") or not short:
            out.append(m.end())
    return out
