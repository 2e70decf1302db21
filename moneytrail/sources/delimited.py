"""Delimited files kept whole in a row: lines, delimiter, header, records, kinds of values.

Pure functions for Arrow batches.  One record is one physical line.
"""

from __future__ import annotations

import datetime as dt
import re
from collections import Counter
from dataclasses import dataclass, field

DELIMITERS = ",;\t|"
SIGNS = "₮$€₽₸¥£"
FLAGS = {"y", "n", "yes", "no", "true", "false", "t", "f", "0", "1", "тийм", "үгүй", "да", "нет", "on", "off", "т", "ү"}

_NUMBER = re.compile(r"(?:\d+|\d{1,3}(?:([,.'  ’])\d{3})(?:\1\d{3})*)(?:[.,]\d+)?")
_CLOCK = re.compile(r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?: ?([AaPp])[Mm])?(Z|[+-]\d{2}:?\d{2})?")
_DATE = re.compile(r"(\d{4})([-./])(\d{1,2})\2(\d{1,2})|(\d{1,2})([-./])(\d{1,2})\6(\d{4})|(\d{4})(\d{2})(\d{2})")


def split_line(line: str, delimiter: str) -> tuple[list[str], bool]:
    """(fields, quoting is right) of one line; a field is quoted if it begins with a quote."""
    if '"' not in line:
        return line.split(delimiter), True
    out, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            j, text = i + 1, []
            while True:
                k = line.find('"', j)
                if k < 0:
                    return [*out, "".join(text) + line[j:]], False
                text.append(line[j:k])
                if line[k + 1 : k + 2] == '"':
                    text.append('"')
                    j = k + 2
                    continue
                break
            if k + 1 < n and line[k + 1] != delimiter:
                return [*out, "".join(text)], False
            out.append("".join(text))
            i = k + 1
        else:
            k = line.find(delimiter, i)
            k = n if k < 0 else k
            out.append(line[i:k])
            i = k
        if i >= n:
            return out, True
        i += 1
        if i == n:
            return [*out, ""], True


def clean_header(h: str) -> str:
    return h.strip().strip("﻿").strip().strip('"').strip().lower()


@dataclass
class Parsed:
    delimiter: str = ","
    header_line: int = 0  # from 1; 0: there is none
    header: list[str] = field(default_factory=list)
    records: list[tuple[int, str, list[str], bool]] = field(default_factory=list)  # line, raw text, fields, quoting right

    def rows(self) -> list[tuple[int, list[str]]]:
        """Records that parse: right quoting and the header's count."""
        return [(no, f) for no, _, f, ok in self.records if ok and len(f) == len(self.header)]


def parse(content: str | None) -> Parsed:
    """The header is the first line with as many fields (two or more) as most lines have; the
    delimiter is the one for which most lines agree.  Null and empty content, and content
    without such a line, have no header and no records."""
    lines = re.split("\r\n|\n|\r", (content or "").removeprefix("﻿"))
    kept = [(no, x) for no, x in enumerate(lines, 1) if x.strip()]
    best = (0, 0, "", 0)
    for d in DELIMITERS:
        counts = Counter(len(f) for f, ok in (split_line(x, d) for _, x in kept) if ok and len(f) > 1)
        if counts:
            width, n = max(counts.items(), key=lambda c: (c[1], c[0]))
            best = max(best, (n, width, d, width))
    n, width, d, _ = best
    if not n:
        return Parsed()
    out = Parsed(d)
    for no, x in kept:
        f, ok = split_line(x, d)
        if not out.header_line:
            if ok and len(f) == width:
                out.header_line, out.header = no, [clean_header(h) for h in f]
            continue
        if ok and len(f) == width and [clean_header(h) for h in f] == out.header:
            continue
        out.records.append((no, x, f, ok))
    return out


def plain_number(value: str) -> str | None:
    """The digits of one number without sign, currency sign and blanks; None if it isn't one."""
    v = value.strip()
    v = v.lstrip("+-−").strip()
    v = v.strip(SIGNS).strip()
    v = v.lstrip("+-−")
    return v if _NUMBER.fullmatch(v) else None


def has_fraction(number: str) -> bool:
    m = re.search(r"[.,](\d+)$", number)
    return bool(m) and not (len(m[1]) == 3 and re.fullmatch(r"\d{1,3}([,.'])\d{3}(\1\d{3})*", number))


def shape(value: str) -> str:
    """The value's form: digits as 9, one- and two-digit clock hours and days alike."""
    return re.sub(r"\d", "9", value.strip())


def date_form(value: str) -> str | None:
    """The form of a value that looks like a date, date with time or epoch number."""
    v = value.strip()
    if re.fullmatch(r"\d{10}|\d{13}", v):
        return "epoch" if "1000000000" <= v[:10] <= "2000000000" else None
    m = _DATE.match(v)
    if not m:
        return None
    rest = v[m.end() :]
    kind = ("y" + m[2]) if m[1] else ("d" + m[6]) if m[5] else "s"
    if not rest:
        return kind if kind != "s" or "19000101" <= v <= "21001231" else None
    if rest[0] in " T" and _CLOCK.fullmatch(rest[1:].strip()):
        return kind + " clock"
    return None


def exists(value: str, form: str, month_first: bool) -> bool:
    """The value is an existing date (and clock) in the form of its column."""
    if date_form(value) != form:
        return False
    if form == "epoch":
        return True
    v = value.strip()
    m = _DATE.match(v)
    if m[1]:
        y, mo, d = m[1], m[3], m[4]
    elif m[5]:
        y, mo, d = (m[8], m[5], m[7]) if month_first else (m[8], m[7], m[5])
    else:
        y, mo, d = m[9], m[10], m[11]
    try:
        dt.date(int(y), int(mo), int(d))
    except ValueError:
        return False
    if form.endswith("clock"):
        c = _CLOCK.fullmatch(v[m.end() + 1 :].strip())
        return int(c[1]) < 24 and int(c[2]) < 60 and int(c[3] or 0) < 60
    return True


def column_form(values: list[str]) -> tuple[str | None, bool]:
    """(the form that most non-empty values have, whether the month comes first in it)."""
    forms = Counter(f for v in values if v.strip() and (f := date_form(v)))
    if not forms:
        return None, False
    form = max(forms, key=lambda f: (forms[f], f))
    if not form.startswith("d"):
        return form, False
    good = [sum(exists(v, form, mf) for v in values) for mf in (False, True)]
    return form, good[1] > good[0]


def column_type(values: list[str]) -> str:
    """fraction, whole, date, datetime, epoch, flag or text: what most non-empty values are; '' if all are empty."""
    kinds: Counter = Counter()
    full = [v.strip() for v in values if v.strip()]
    if not full:
        return ""
    low = Counter(v.lower() for v in full)
    if sum(n for v, n in low.items() if v in FLAGS) >= 0.8 * len(full):
        return "flag"
    for v in full:
        f = date_form(v)
        if f == "epoch":
            kinds["epoch"] += 1
        elif f:
            kinds["datetime" if f.endswith("clock") else "date"] += 1
        elif (number := plain_number(v)) is not None:
            kinds["fraction" if has_fraction(number) else "whole"] += 1
        else:
            kinds["text"] += 1
    if kinds["epoch"] and kinds["epoch"] < 0.8 * len(full):
        kinds["whole"] += kinds.pop("epoch")
    if kinds["fraction"] and kinds["fraction"] + kinds["whole"] >= 0.5 * len(full):
        return "fraction" if kinds["fraction"] >= 0.2 * (kinds["fraction"] + kinds["whole"]) else "whole"
    return max(kinds, key=lambda k: (kinds[k], k))
