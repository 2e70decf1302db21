"""Pure text helpers for headers and labels."""

from __future__ import annotations

import re
import unicodedata

_LATIN = dict(zip("абвгдеёжзиійклмноөпрстуүфхцчшщыьэ", "abvgdeojziiiklmnooprstoufhccsЩiie"))
_LATIN |= {"щ": "s", "ю": "yu", "я": "ya", "ъ": "", "ү": "o", "у": "o", "ж": "j"}


def skeleton(text: str) -> str:
    """Lower-case Latin letters and digits of a text in either script; rounded vowels are one letter."""
    t = unicodedata.normalize("NFKC", text).lower()
    t = "".join(_LATIN.get(c, c) for c in t)
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if c.isalnum())
    for a, b in (("zh", "j"), ("kh", "h"), ("ts", "c"), ("ch", "c"), ("sh", "s"), ("u", "o")):
        t = t.replace(a, b)
    return t


def similarity(a: str, b: str) -> float:
    """2 |longest common subsequence| / (|a| + |b|)."""
    if not a or not b:
        return float(a == b)
    prev = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
        prev = row
    return 2 * prev[-1] / (len(a) + len(b))


# Decorations that systems put around a header.
_DECORATION = re.compile(r"^(?:new|old|the|x)[ _]+|[ _]+(?:x|new|old|v\d+)$|\([^)]*\)$|/[^/]*/$|(?<=...)col$|(?<=\D)\d$")


def undecorated(header: str) -> str:
    h = " ".join(header.lower().split())
    while (k := _DECORATION.sub("", h).strip(" _")) and k != h:
        h = k
    return h
