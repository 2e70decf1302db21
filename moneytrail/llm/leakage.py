"""Problem 9: passages of evaluation items inside a corpus.

Texts are folded (Unicode form, case, look-alike letters, digit grouping, punctuation) into
words, Chinese into characters.  Windows of item passages and of documents are embedded by
CGK random walks, so that a small edit distance becomes a small Hamming distance; bands of
sampled positions are looked up in the items' bands; each (document, item) that shares a band
is verified exactly by chaining common blocks under an edit bound.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moneytrail.llm.names import fold
from moneytrail.plans.session import spread, table

WORDS, CHARS = 20, 30  # least run of successive words, of characters of Chinese
WINDOW = {"w": 14, "c": 20}  # windows shorter than the least run, so that some hold few changes
MAPS, BANDS, SAMPLED = 4, 4, 6  # random walks, bands of each, positions sampled in a band
GAP = {"w": 1, "c": 2}  # a changed word, in characters a changed word of two
ERRORS_PER = 8  # at most one changed word in so many, on average
BLOCK_WINDOWS = 1_000_000  # item windows that are broadcast at once; more are scanned in blocks

_CJK = re.compile("[㐀-鿿]")
_GROUPED = re.compile(r"(?<=\d)[ ,.'’  ](?=\d{3}(?!\d))")
_PART = re.compile(r"[^\W_]+")
_PIECE = re.compile("[㐀-鿿]|[^\\s㐀-鿿]+")
_known: dict[str, int] = {}


def _symbol(word: str) -> int:
    h = _known.get(word)
    if h is None:
        import xxhash

        parts = [p.lstrip("0") or "0" if p.isdigit() else fold(p) for p in _PART.findall(word)]
        text = "".join(parts)
        h = (xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) | 1) if text else 0
        if len(_known) > 500_000:
            _known.clear()
        _known[word] = h
    return h


def plain(text: str) -> str:
    t = unicodedata.normalize("NFKC", text)
    if not t.isascii():
        t = "".join(c for c in t if unicodedata.category(c) != "Cf")
    return _GROUPED.sub("", t).lower()


def word_symbols(t: str) -> np.ndarray:
    """Symbols of the words of a plain text; each Chinese character is a word."""
    s = np.array([_symbol(w) for w in _PIECE.findall(t)], dtype=np.uint64)
    return s[s != 0]


def char_symbols(t: str) -> np.ndarray:
    return np.array([ord(c) * 0x9E3779B97F4A7C15 & (2**64 - 1) | 1 for c in t if c.isalnum()], dtype=np.uint64)


def streams(text: str | None) -> dict[str, np.ndarray]:
    """The symbol sequences of a text: 'w' words, and 'c' characters where it holds Chinese."""
    if not text:
        return {}
    t = plain(text)
    out = {"w": word_symbols(t)}
    if _CJK.search(t):
        out["c"] = char_symbols(t)
    return out


def item_kind(passage: str) -> str:
    letters = [c for c in passage if c.isalpha()]
    return "c" if 2 * sum(bool(_CJK.match(c)) for c in letters) >= len(letters) > 0 else "w"


def walk_bands(symbols: np.ndarray, starts: np.ndarray, window: int, seed: int = 9) -> list[np.ndarray]:
    """Band hashes of the windows at starts, one array per band.

    CGK: at step j the walk writes the symbol it stands on and moves on if a random bit of
    (j, symbol) is set; beyond the window's end it writes nothing.  Each band hashes the
    symbols written at SAMPLED random steps.  A walk mixes each symbol once: its bit j moves
    step j, the whole is what is written.
    """
    rng = np.random.default_rng(seed)
    steps = 2 * window
    padded = np.concatenate([symbols, np.zeros(1, np.uint64)])
    end = starts + window
    last = len(padded) - 1
    out = []
    one = np.uint64(1)
    with np.errstate(over="ignore"):
        for _ in range(MAPS):
            odd = rng.integers(0, 2**63, 2, dtype=np.uint64) * np.uint64(2) + one
            picks = [set(rng.choice(steps, SAMPLED, replace=False).tolist()) for _ in range(BANDS)]
            salts = rng.integers(1, 2**62, BANDS, dtype=np.uint64)
            mixed = padded * odd[0]
            mixed ^= mixed >> np.uint64(31)
            mixed *= odd[1]
            mixed ^= mixed >> np.uint64(29)
            acc = [np.full(len(starts), s, np.uint64) for s in salts]
            pos = starts.astype(np.int64)
            for j in range(steps):
                # a walk takes at most one step at a time, so it can leave its window only after that many
                v = mixed[pos if j < window else np.where(pos < end, pos, last)]
                for k in range(BANDS):
                    if j in picks[k]:
                        acc[k] ^= v
                        acc[k] *= np.uint64(0x100000001B3)
                        acc[k] += np.uint64(j)
                if j + 1 < steps:
                    v >>= np.uint64(j)
                    v &= one
                    pos += v.view(np.int64)
            out += acc
    return out


BLOCK = 6  # symbols: a run of L has at most e = L // ERRORS_PER errors, so one of its e + 1 blocks has (L - e) / (e + 1), which is above 5 for all L from WORDS on


def may_hold(doc: np.ndarray, item_sorted: np.ndarray, least: int, errors_per: int = ERRORS_PER) -> bool:
    """False only if no run of `least` item symbols fits into doc.

    Some `least` successive symbols of a run have at most e = (2 least - 1) // errors_per errors,
    so a stretch of least + e document symbols holds least - e symbols of the item."""
    e = (2 * least - 1) // errors_per
    at = np.minimum(np.searchsorted(item_sorted, doc), len(item_sorted) - 1)
    seen = np.concatenate([[0], np.cumsum(item_sorted[at] == doc)])
    span = min(least + e, len(doc))
    return bool((seen[span:] - seen[: len(seen) - span]).max() >= least - e)


def longest_run(doc: np.ndarray, item: np.ndarray, gap: int, errors_per: int = ERRORS_PER) -> int:
    """Item symbols in the longest run that doc shares with item: common blocks chained over at
    most `gap` changed, added or left-out symbols, at most one error in errors_per symbols."""
    # all pairs of equal symbols, ordered along diagonals; blocks are their unbroken stretches
    order = np.argsort(item, kind="stable")
    ranked = item[order]
    lo, hi = np.searchsorted(ranked, doc, "left"), np.searchsorted(ranked, doc, "right")
    n = hi - lo
    if not n.any():
        return 0
    i = np.repeat(np.arange(len(doc)), n)
    j = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    wide = len(doc) + 1
    key = np.sort((j - i + len(doc)) * wide + i)
    cut = np.flatnonzero(np.concatenate([[True], np.diff(key) != 1, [True]]))
    length = np.diff(cut)
    if length.max() < BLOCK:
        return int(length.max())
    first = key[cut[:-1]]
    keep_ = length >= 2
    start = first[keep_] % wide
    blocks = sorted(zip(start.tolist(), (first[keep_] // wide - len(doc) + start).tolist(), length[keep_].tolist()))
    best = 0
    states: list[list[tuple[int, int]]] = []  # per block: (item start, errors) of chains that end in it
    ends: dict[int, list[int]] = {}
    for x, (i, j, n) in enumerate(blocks):
        chains = [(j, 0)]
        for gi in range(gap + 1):
            for y in ends.get(i - gi, ()):
                pi, pj, pn = blocks[y]
                gj = j - (pj + pn)
                if 0 <= gj <= gap and gi + gj > 0:
                    chains += [(s, e + max(gi, gj)) for s, e in states[y]]
        keep: dict[int, int] = {}
        for s, e in chains:
            if e < keep.get(s, 1 << 30):
                keep[s] = e
        states.append(list(keep.items()))
        ends.setdefault(i + n, []).append(x)
        for s, e in keep.items():
            length = j + n - s
            if length > best and e * errors_per <= length:
                best = length
    return best


@dataclass
class Probe:
    """Items of one block with their sorted band hashes; sent to the executors."""

    kinds: dict[int, str]
    symbols: dict[int, np.ndarray]
    ordered: dict[int, np.ndarray]
    hashes: dict[str, list[np.ndarray]]
    owners: dict[str, list[np.ndarray]]


def build_probe(items: list[tuple[int, str]]) -> Probe:
    kinds, symbols, parts = {}, {}, {"w": [], "c": []}
    for item, passage in items:
        kind = item_kind(passage)
        s = streams(passage).get(kind, np.array([], np.uint64))
        kinds[item], symbols[item] = kind, s
        if len(s) >= WINDOW[kind]:
            starts = np.arange(len(s) - WINDOW[kind] + 1)
            parts[kind].append((item, walk_bands(s, starts, WINDOW[kind])))
    hashes, owners = {}, {}
    for kind, found in parts.items():
        hashes[kind], owners[kind] = [], []
        for band in range(MAPS * BANDS if found else 0):
            h = np.concatenate([b[band] for _, b in found])
            o = np.concatenate([np.full(len(b[band]), item, np.int64) for item, b in found])
            order = np.argsort(h, kind="stable")
            hashes[kind].append(h[order])
            owners[kind].append(o[order])
    return Probe(kinds, symbols, {k: np.unique(s) for k, s in symbols.items()}, hashes, owners)


def _candidates(probe: Probe, kind: str, texts: list[np.ndarray]) -> set[tuple[int, int]]:
    """(position in texts, item) that share a band."""
    window = WINDOW[kind]
    if not probe.hashes[kind]:
        return set()
    long_enough = [k for k, t in enumerate(texts) if len(t) >= window]
    if not long_enough:
        return set()
    sizes = np.array([len(texts[k]) for k in long_enough])
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    symbols = np.concatenate([texts[k] for k in long_enough])
    starts = np.concatenate([b + np.arange(n - window + 1) for b, n in zip(base, sizes)])
    owner = np.repeat(np.array(long_enough), sizes - window + 1)
    out: set[tuple[int, int]] = set()
    for band, h in enumerate(walk_bands(symbols, starts, window)):
        table_, items = probe.hashes[kind][band], probe.owners[kind][band]
        lo = np.searchsorted(table_, h, "left")
        hit = np.flatnonzero((lo < len(table_)) & (table_[np.minimum(lo, len(table_) - 1)] == h))
        if len(hit):
            hi = np.searchsorted(table_, h[hit], "right")
            n = hi - lo[hit]
            docs = np.repeat(owner[hit], n)
            at = np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.update(zip(docs.tolist(), items[at].tolist()))
    return out


def find_in(texts: list[str | None], probe: Probe) -> list[tuple[int, int]]:
    """(position in texts, item) of the leaked items."""
    found = []
    read = [streams(t) for t in texts]
    for kind in ("w", "c"):
        seqs = [r.get(kind, np.array([], np.uint64)) for r in read]
        least = WORDS if kind == "w" else CHARS
        # about 300,000 symbols at a time
        begin = 0
        while begin < len(seqs):
            stop, total = begin, 0
            while stop < len(seqs) and (stop == begin or total + len(seqs[stop]) <= 300_000):
                total += len(seqs[stop])
                stop += 1
            for k, item in _candidates(probe, kind, seqs[begin:stop]):
                if may_hold(seqs[begin + k], probe.ordered[item], least) and longest_run(seqs[begin + k], probe.symbols[item], GAP[kind]) >= least:
                    found.append((begin + k, item))
            begin = stop
    return found


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, itemid) of each document (doc_id, text) that holds a run of an item's passage.

    One scan of docs per block of BLOCK_WINDOWS item windows, without a shuffle; the items
    (a stated query set) are broadcast block by block.  Null, empty and short texts and
    passages match nothing; repeated rows give one result row; empty tables none.
    """
    spark = docs.sparkSession
    rows = [(r["itemid"], r["passage"]) for r in items.where("itemid is not null and passage is not null").select("itemid", "passage").toLocalIterator()]
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for item, passage in rows:
        if size + len(passage) > BLOCK_WINDOWS and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((item, passage))
        size += len(passage)
    result = None
    texts = spread(docs.where("text is not null and doc_id is not null").select("doc_id", "text"))
    for block in blocks:
        shared = spark.sparkContext.broadcast(build_probe(block))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                ids = b.doc_id.to_numpy()
                found = find_in(list(b.text), shared.value)
                yield pd.DataFrame({"doc_id": [ids[k] for k, _ in found], "itemid": [i for _, i in found]}, dtype="int64")

        part = texts.mapInPandas(run, "doc_id long, itemid long")
        result = part if result is None else result.unionByName(part)
    return result.distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
