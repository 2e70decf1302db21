"""Problem 8: encoding of the whole corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moneytrail.plans.session import local_path, spread, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern of the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_PIECES = 200_000  # pieces of at most CACHED_BYTES that one worker remembers
CACHED_BYTES = 48
NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(local_path(path), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece.

    A segment tree over the positions holds for each the rank of the pair that begins there,
    with its position in the low bits, and above them the minimum: the root is the leftmost of
    the lowest-ranked pairs.  A merge changes three leaves, so n bytes take O(n log n) steps.
    """
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    parts = [piece[i : i + 1] for i in range(n)]
    bits = (n - 1).bit_length()
    size, mask = 1 << bits, (1 << bits) - 1
    get = ranks.get
    tree = [NEVER] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << bits | i
    for p in range(size - 1, 0, -1):
        a, b = tree[2 * p], tree[2 * p + 1]
        tree[p] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while tree[1] < NEVER:
        i = tree[1] & mask
        j = after[i]
        parts[i] += parts[j]
        k = after[i] = after[j]
        if k < n:
            before[k] = i
        changes = [(j, NEVER)]
        r = get(parts[i] + parts[k]) if k < n else None
        changes.append((i, NEVER if r is None else r << bits | i))
        if (h := before[i]) >= 0:
            r = get(parts[h] + parts[i])
            changes.append((h, NEVER if r is None else r << bits | h))
        parts[j] = b""
        for q, value in changes:
            p = size + q
            tree[p] = value
            p >>= 1
            while p:
                a, b = tree[2 * p], tree[2 * p + 1]
                v = a if a < b else b
                if tree[p] == v:
                    break
                tree[p] = v
                p >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[parts[i]])
        i = after[i]
    return out


def encoder(ranks: dict[bytes, int], pattern: str = PATTERN) -> Callable[[str | None], list[int]]:
    """A function from a text to its ids; [] for null and empty text."""
    import regex

    split = regex.compile(pattern).findall
    known: dict[str, list[int]] = {}

    def encode(text: str | None) -> list[int]:
        out: list[int] = []
        for piece in split(text) if text else ():
            ids = known.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "surrogatepass")
                ids = merge_piece(raw, ranks)
                if len(raw) <= CACHED_BYTES:
                    if len(known) >= CACHED_PIECES:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    return encode


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row of docs, by one scan without a shuffle.

    Null and empty texts have an empty list; strings of special tokens are ordinary text;
    repeated rows stay rows.  The vocabulary (under 1 MB) is broadcast.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(shared.value, pattern)
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "ids": [encode(t) for t in b.text]})

    return spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInPandas(run, "doc_id long, ids array<int>")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
