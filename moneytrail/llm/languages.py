"""Problem 10: language of each segment of each document, with confidence.

Multinomial naive Bayes over hashed character n-grams.  It is trained here, on SAMPLE
documents of the corpus itself (by a fixed hash of their ids): first on the delivered labels
(missing and wrong ones are noise), then on its own answers of the round before.  A language written in two scripts has a distribution for each,
and a segment is compared with those of its own script, so that a rare script of a language
isn't outweighed by its usual one.  Counts are added up per hash bucket, and only the matrix of scripts x languages x BUCKETS (a fixed size) is broadcast.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moneytrail.llm.names import unmix
from moneytrail.plans.session import save, spread, table

LANGS = ["de", "en", "kk", "mn", "ru", "zh"]
SCRIPTS = 3  # Latin, Cyrillic, Chinese
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
SAMPLE = 20_000  # documents that the classifier is fitted on, at most; all are then scored
ROUNDS = 2  # trainings on the model's own answers
SMOOTHING = 0.05
SHRINKAGE = 0.3  # of all grams of a script, as pseudo-counts of each of its languages
PRIOR_WEIGHT = 30
SLICE = 400_000  # characters that are scored at once

# Codes and names under which labels state one of the languages.
CODES_TEXT = """
mn mon khk mongolian монгол | ru rus russian русский | kk kaz kazakh қазақ
| en eng english | de deu ger german deutsch | zh zho chi cmn chinese 中文
"""
CODES = {c: group.split()[0] for group in CODES_TEXT.split("|") for c in group.split()}
# Labels that name no language.
NO_LANGUAGE = {"", "und", "unk", "unknown", "xx", "mul", "zxx", "mis", "none", "null", "n/a", "na", "-"}

_LINES = re.compile("\r\n|[\n\r\x0b\x0c\x85  ]")
_DIGITS = re.compile(r"\d+")
_LATIN, _CYRILLIC, _CHINESE = (re.compile(x) for x in ("[a-zà-ÿ]", "[Ѐ-ӿ]", "[㐀-鿿]"))


def stated(label: str | None) -> str | None:
    """The language that a label states: a code of LANGS, "other" for another language, None for none."""
    code = re.split(r"[-_]", (label or "").strip().lower())[0]
    if code in NO_LANGUAGE or not code.isalpha():
        return None
    return CODES.get(code, "other")


def segments(text: str | None) -> list[str]:
    """The non-blank lines."""
    return [s for s in _LINES.split(text or "") if s.strip("​﻿" + " \t") and s.strip()]


def prepared(segment: str) -> str:
    t = unicodedata.normalize("NFKC", segment).lower()
    if _CYRILLIC.search(t) and _LATIN.search(t):
        t = " ".join(map(unmix, t.split()))
    return " " + " ".join(_DIGITS.sub("0", t).split()) + " "


def script(t: str) -> int:
    latin, cyrillic, chinese = (len(x.findall(t)) for x in (_LATIN, _CYRILLIC, _CHINESE))
    return 2 if 5 * chinese > latin + cyrillic else int(4 * cyrillic > latin)


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, position of its text) of every character n-gram inside each text."""
    sizes = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    found, owners = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            m = len(codes) - n + 1
            if m <= 0:
                break
            h = (h[:m] * np.uint64(0x100000001B3)) ^ (codes[n - 1 :] + np.uint64(n))
            if n in ORDERS:
                inside = owner[:m] == owner[n - 1 :]
                mixed = h * np.uint64(0x9E3779B97F4A7C15)
                found.append((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1))[inside].astype(np.int64))
                owners.append(owner[:m][inside])
    return np.concatenate(found), np.concatenate(owners)


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    begin = 0
    while begin < len(texts):
        stop, total = begin, 0
        while stop < len(texts) and (stop == begin or total + len(texts[stop]) <= SLICE):
            total += len(texts[stop])
            stop += 1
        yield begin, texts[begin:stop]
        begin = stop


def score(texts: list[str], scripts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best language and its probability for each prepared text.

    The grams of a text overlap, so their evidence is divided by the number of orders and
    damped by the square root of its length: confidences stay below 1 for short texts."""
    best, sure = np.zeros(len(texts), int), np.zeros(len(texts))
    for kind in range(SCRIPTS):
        rows = np.flatnonzero(scripts == kind)
        for begin, part in _slices([texts[r] for r in rows]):
            bucket, owner = gram_buckets(part)
            total = np.stack([np.bincount(owner, weights=w[bucket], minlength=len(part)) for w in weights[kind]], axis=1) + weights[kind][:, -1]
            n = np.maximum(np.bincount(owner, minlength=len(part)), 1)
            p = total / np.sqrt(n)[:, None] / len(ORDERS)
            p = np.exp(p - p.max(axis=1, keepdims=True))
            at = rows[begin : begin + len(part)]
            best[at] = total.argmax(axis=1)
            sure[at] = p.max(axis=1) / p.sum(axis=1)
    return best, sure


def log_weights(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of the buckets by script and language; in the last place the log prior.

    A language's counts are shrunk towards those of its script as a whole: one that has only a
    few mislabelled segments in a script then looks like the script's average there and is
    outweighed by the prior of the languages really written in it."""
    script_counts = counts.sum(axis=1, keepdims=True) + SMOOTHING
    total = script_counts.sum(axis=-1, keepdims=True)
    mass = SHRINKAGE * total
    own = counts.sum(axis=-1, keepdims=True)
    w = np.log((counts + mass * script_counts / total) / (own + mass))
    prior = np.log((own + 1) / (total + len(LANGS)))
    return np.concatenate([w, PRIOR_WEIGHT * prior], axis=-1)


def train(docs: DataFrame) -> np.ndarray:
    """The matrix of log probabilities, from all segments of SAMPLE documents (doc_id, text, lang)."""
    spark = docs.sparkSession
    weights = None
    full = docs.where("text is not null")
    ids = full.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = save(full.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id", "left_semi"))  # at most SAMPLE ids
    texts = spread(sample.select("text", "lang"))
    for _ in range(1 + ROUNDS):
        shared = spark.sparkContext.broadcast(None if weights is None else weights.astype(np.float32))

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            counts = np.zeros(SCRIPTS * len(LANGS) * BUCKETS)
            for b in batches:
                texts, labels = [], []
                for text, lang in zip(b.text, b.lang):
                    state = stated(lang)
                    if shared.value is None and state not in LANGS:
                        continue
                    for s in segments(text):
                        texts.append(prepared(s))
                        labels.append(LANGS.index(state) if shared.value is None else -1)
                for begin, part in _slices(texts):
                    which = np.array(labels[begin : begin + len(part)])
                    kinds = np.array([script(t) for t in part])
                    if shared.value is not None:
                        which = score(part, kinds, shared.value)[0]
                    bucket, owner = gram_buckets(part)
                    cell = (kinds * len(LANGS) + which)[owner] * BUCKETS + bucket
                    counts += np.bincount(cell, minlength=counts.size)
            cell = np.flatnonzero(counts)
            yield pd.DataFrame({"cell": cell, "n": counts[cell]})

        cells = texts.mapInPandas(count, "cell long, n double")
        got = cells.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most SCRIPTS x LANGS x BUCKETS rows
        counts = np.zeros(SCRIPTS * len(LANGS) * BUCKETS)
        counts[got.cell.to_numpy(int)] = got.n
        weights = log_weights(counts.reshape(SCRIPTS, len(LANGS), BUCKETS))
        if not counts.any():
            break
    return weights


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, segment_no, lang, confidence, label_ok) of each non-blank line of each document.

    label_ok: the delivered label states the one language of all segments.  Null, empty and
    blank texts have no segment; repeated rows stay rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs).astype(np.float32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, where = [], []
            for k, text in enumerate(b.text):
                for no, s in enumerate(segments(text), 1):
                    texts.append(prepared(s))
                    where.append((k, no))
            best, sure = score(texts, np.array([script(t) for t in texts], int), shared.value)
            k = np.array([w[0] for w in where], int)
            lang = np.array(LANGS, object)[best] if len(best) else np.array([], object)
            state = np.array([stated(x) for x in b.lang], object)
            ok = np.ones(len(b), bool)
            np.logical_and.at(ok, k, lang == state[k] if len(k) else np.array([], bool))
            yield pd.DataFrame(
                {"doc_id": b.doc_id.to_numpy()[k], "segment_no": np.array([w[1] for w in where], "int64"), "lang": lang, "confidence": sure.astype("float64"), "label_ok": ok[k]}
            )

    return spread(docs.where("text is not null").select("doc_id", "text", "lang")).mapInPandas(run, "doc_id long, segment_no long, lang string, confidence double, label_ok boolean")


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment with its language and confidence."""
    return identify(table(spark, sf_dir, "documents")).select("doc_id", "segment_no", "lang", F.round("confidence", 6).alias("confidence"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of documents whose label is missing or wrong or whose segments differ."""
    return identify(table(spark, sf_dir, "documents")).where("not label_ok").select("doc_id", "segment_no", "lang")
