"""Names typed by people: folding of scripts and transliterations, parsing, comparison.

Pure functions, used inside Arrow batches.  A name is reduced to its content tokens (given,
father's and further names of a person, proper and sector word of an organisation), all of
them kept; titles, legal forms and case endings are dropped.  Everything else is decided by
comparing tokens, so no list of given names or sectors is needed.
"""

from __future__ import annotations

import functools
import re
import unicodedata

# Titles, fillers and legal forms that carry no identity (folded spelling).
FILLERS_TEXT = """
гуай овогтой овогт ийн ын хувь иргэн шилжүүлэг мистер ноён хатагтай г-н господин
mr mrs ms dr herr frau owogtoi
ххк хк тбб төхк компани компания банк салбар нүтбб
xxk xk tbb llc ltd limited corp corporation co company inc jsc ngo plc gmbh ag
guai guay ovogtoi ovogt irgen shiljuuleg khuvi huvi kompani
"""
# Adjectives that mark a street name (alias) rather than a personal name.
EPITHETS_TEXT = "хар их жижиг бага том цагаан шар бор khar har ikh ih jijig zhizhig baga tom"
# Endings of pet forms, put after the first letters of a name.
PET_ENDINGS_TEXT = "ээ оо ка хай аа ке ко"
# Latin letters that look like Cyrillic ones.
LOOKALIKES = str.maketrans("aceopxyABCEHKMOPTXYi", "асеорхуАВСЕНКМОРТХУі")
# One Latin sign for each Cyrillic letter; C = ch, S = sh.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "io", "ж": "j", "з": "z", "и": "i", "і": "i", "й": "i",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "ө": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "o", "ү": "o",
    "ф": "f", "х": "h", "ц": "c", "ч": "C", "ш": "S", "щ": "S", "ъ": "", "ы": "i", "ь": "i", "э": "e", "ю": "io", "я": "ia",
}

_CYR = re.compile("[Ѐ-ӿ]")
_LAT = re.compile("[A-Za-z]")
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-zа-яёөү])(?=[A-ZА-ЯЁӨҮ])")
_RUN = re.compile(r"(.)\1+")
_GENITIVE = re.compile(r"(?<=...)(?:гийн|ийн|ын)$")


def unmix(token: str) -> str:
    """A token in two scripts is Cyrillic typed with Latin look-alikes."""
    if _CYR.search(token) and _LAT.search(token):
        return token.translate(LOOKALIKES)
    return token


def fold(token: str) -> str:
    """One spelling for all transliterations: rounded vowels are one letter, doubled letters single."""
    t = unmix(token).lower()
    pet = re.fullmatch(r"(..+)(?:хай|khai|(?<![szc])hai)", t)
    if pet:  # the stem's last letter and the ending are no digraph
        return fold(pet[1]) + "hai"
    if _CYR.search(t):
        t = _GENITIVE.sub("", t)
        t = "".join(CYRILLIC.get(c, c) for c in t)
        for a, b in (("zh", "j"), ("kh", "h"), ("dz", "z"), ("ts", "c"), ("ch", "C"), ("sh", "S"), ("tS", "C")):
            t = t.replace(a, b)
    else:
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        for a, b in (
            ("tsh", "C"), ("zh", "j"), ("kh", "h"), ("dz", "z"), ("ts", "c"), ("ch", "C"), ("sh", "S"),
            ("ye", "e"), ("ya", "ia"), ("yu", "io"), ("yo", "io"), ("y", "i"), ("x", "h"), ("w", "v"), ("q", "k"),
        ):
            t = t.replace(a, b)
    return _RUN.sub(r"\1", t.replace("u", "o"))


FILLERS = {fold(x) for x in FILLERS_TEXT.replace("-", " ").split()} - {fold("г"), fold("н"), "n", "g"}
EPITHETS = {fold(x) for x in EPITHETS_TEXT.split()}
PETS = tuple(sorted({fold(x) for x in PET_ENDINGS_TEXT.split()}, key=len, reverse=True))


def token(raw: str) -> str:
    """The folded word, with "=" and the word itself where it is Cyrillic; common words are remembered."""
    return _known_token(raw) if len(raw) <= 40 else _token(raw)


def _token(raw: str) -> str:
    t = _GENITIVE.sub("", unmix(raw).lower())
    return f"{fold(raw)}={t}" if _CYR.search(t) else fold(raw)


_known_token = functools.lru_cache(1 << 15)(_token)


def folded(t: str) -> str:
    return t.partition("=")[0]


def tokens(text: str | None) -> list[str]:
    """Content tokens in order, see token(); [] for null or blank text."""
    if not text:
        return []
    out = []
    for raw in _WORD.findall(unicodedata.normalize("NFKC", text)):
        parts = _CAMEL.split(raw)
        if len(parts) > 1 and min(map(len, parts)) < 4:
            parts = [raw]  # mixed case inside a word, not two words written together
        for part in parts:
            t = token(part)
            if folded(t) and folded(t) not in FILLERS:
                out.append(t)
    return out


def lcs_ratio(a: str, b: str) -> float:
    """2 |longest common subsequence| / (|a| + |b|), by bit-parallel rows."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return 2 * (len(a) - v.bit_count()) / (len(a) + len(b))


LONG = 10  # letters from which a word may bear two errors
MOST = 8  # tokens of a name of kind F; one with more is of kind L and matched by augmenting paths


def least_ratio(a: str, b: str) -> float:
    """The least lcs_ratio of two spellings of a word: what one letter replaced, left out or moved
    leaves of the longer one, in words of LONG letters and more two letters."""
    n = max(len(a), len(b))
    return 2 * (n - (2 if n >= LONG else 1)) / (len(a) + len(b))


def alike(a: str, b: str) -> bool:
    return lcs_ratio(a, b) >= least_ratio(a, b) - 1e-9


def same_token(a: str, b: str) -> bool:
    """The same word by the ratio of its longest common subsequence; words of one script by their own
    letters, others by their folded ones."""
    if a == b:
        return True
    fa, _, ra = a.partition("=")
    fb, _, rb = b.partition("=")
    if ra and rb:
        return min(len(ra), len(rb)) >= 3 and max(len(ra), len(rb)) >= 4 and alike(ra, rb)
    if fa == fb:
        return True
    return min(len(fa), len(fb)) >= 5 and alike(fa, fb)


def is_pet(short: str, full: str) -> bool:
    """short is a pet form of full: its first letters and a pet ending (folded words)."""
    for end in PETS:
        stem = short[: -len(end)]
        if short.endswith(end) and len(stem) >= 2 and full.startswith(stem):
            return True
    return False


def shortens(short: str, full: str) -> bool:
    """short is an initial, a cut form or a pet form of full."""
    short, full = folded(short), folded(full)
    if len(short) >= len(full) + 2:
        return False
    return (len(short) < len(full) and full.startswith(short)) or is_pet(short, full)


Name = tuple[str, tuple[str, ...]]  # kind, tokens


def parse(text: str | None) -> Name | None:
    """(kind, tokens) of one written name, None without content.

    kind 'F': two to MOST tokens in alphabetical order, all of the name's but initials that
    repeat the beginning of another; 'L': the same with more tokens, all of them kept; 'N': a
    single token, or a street name with its epithet dropped.
    """
    ts = tokens(text)
    if not ts:
        return None
    rest = [t for t in ts if folded(t) not in EPITHETS]
    if rest and len(rest) < len(ts):
        if len(rest) == 1:
            return "N", (rest[0],)
        ts = rest
    if len(ts) > 2:
        full = [t for t in ts if len(folded(t)) > 1]
        kept = [t for t in ts if len(folded(t)) > 1 or not any(folded(f).startswith(folded(t)) for f in full)]
        ts = kept if len(kept) >= 2 else ts
    if len(ts) == 1:
        return "N", (ts[0],)
    return "L" if len(ts) > MOST else "F", tuple(sorted(ts))


def joined(name: Name) -> str:
    return "|".join((name[0], *name[1]))


def parted(text: str) -> Name:
    kind, *ts = text.split("|")
    return kind, tuple(ts)


def alias_parts(aliases: str | None, full_name: str | None) -> list[str]:
    """The aliases in a free list; a comma or slash may also stand inside one name."""
    own = tokens(full_name)
    out = []
    for part in re.split(r"[;|]", aliases or ""):
        pieces = [p for p in re.split(r"[,/]", part) if tokens(p)]
        if len(pieces) == 2 and all(len(tokens(p)) == 1 for p in pieces):
            x, y = (tokens(p)[0] for p in pieces)
            pet = any(is_pet(folded(t), folded(o)) for t in (x, y) for o in own)
            if not pet and any(same_token(t, o) for t in (x, y) for o in own):
                pieces = [part]
        out += pieces
    return out


def record_names(full_name: str | None, aliases: str | None) -> list[Name]:
    """All parsed names of a record; a lone alias that only shortens or repeats a part of the
    full name identifies nobody and is left out."""
    own = tokens(full_name)
    out = []
    if (p := parse(full_name)) is not None:
        out.append(p)
    for text in alias_parts(aliases, full_name):
        p = parse(text)
        if p is None or (p[0] == "N" and any(same_token(p[1][0], o) or shortens(p[1][0], o) for o in own)):
            continue
        out.append(p)
    return list(dict.fromkeys(out))


def same_name(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    """2: each token of one is the same word as one of the other; 1: one name shortens the other: each
    token of the one with fewer has its own in the other, at least one of five letters the same
    word, the rest the same or shortened; tokens are left out only beside two that are the same;
    0: neither.  Tokens may stand in any order."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 2 == len(b):
        best = 0
        for x, y in ((b[0], b[1]), (b[1], b[0])):
            s, t = same_token(a[0], x), same_token(a[1], y)
            if s and t:
                return 2
            if s and _long(a[0], x) and (shortens(a[1], y) or shortens(y, a[1])):
                best = 1
            elif t and _long(a[1], y) and (shortens(a[0], x) or shortens(x, a[0])):
                best = 1
        return best
    if len(b) > MOST:
        return _same_long_name(a, b) if len(a) >= 2 else 0
    fit = [[2 if same_token(x, y) else 1 if shortens(x, y) or shortens(y, x) else 0 for y in b] for x in a]
    best = 0

    def place(i: int, used: int, same: int, long: bool) -> None:
        nonlocal best
        if i == len(a):
            if same == len(a) == len(b):
                best = 2
            elif long and (len(a) == len(b) or same >= 2):
                best = max(best, 1)
            return
        for j, f in enumerate(fit[i]):
            if f and best < 2 and not used >> j & 1:
                place(i + 1, used | 1 << j, same + (f == 2), long or (f == 2 and _long(a[i], b[j])))

    if len(a) >= 2:
        place(0, 0, 0, False)
    return best


def _long(a: str, b: str) -> bool:
    return max(len(folded(a)), len(folded(b))) >= 5


def _places(rows: list[list[int]], fixed: dict[int, int]) -> bool:
    """Each row can have a column of its own among those listed for it, the fixed ones theirs: augmenting paths."""
    placed, owner = dict(fixed), {j: i for i, j in fixed.items()}
    held = set(owner)
    for start in range(len(rows)):
        if start in fixed:
            continue
        came: dict[int, int] = {}  # column: the row that reached it
        queue, end = [start], None
        for i in queue:
            for j in rows[i]:
                if j not in came and j not in held:
                    came[j] = i
                    if j not in owner:
                        end = j
                        break
                    queue.append(owner[j])
            if end is not None:
                break
        if end is None:
            return False
        while end is not None:  # each row on the path gives its column to the one before it
            i = came[end]
            owner[end], before = i, placed.get(i)
            placed[i], end = end, before
    return True


def _same_long_name(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    """same_name of a and the longer or equally long b, in polynomial time."""
    fit: list[dict[int, int]] = []
    for x in a:
        row = {j: f for j, y in enumerate(b) if (f := 2 if same_token(x, y) else 1 if shortens(x, y) or shortens(y, x) else 0)}
        if not row:
            return 0
        fit.append(row)
    sure = [[j for j, f in row.items() if f == 2] for row in fit]
    if len(a) == len(b) and _places(sure, {}):
        return 2
    rows = [list(row) for row in fit]
    if not _places(rows, {}):
        return 0
    for i, js in enumerate(sure):
        for j in js:
            if _long(a[i], b[j]):
                others = ({i: j, k: m} for k, ms in enumerate(sure) for m in ms if k != i and m != j)
                if any(_places(rows, fixed) for fixed in ([{i: j}] if len(a) == len(b) else others)):
                    return 1
    return 0
