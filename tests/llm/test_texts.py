"""Problems 8, 9 and 10."""

import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from moneytrail.llm import encoding, languages, leakage

RANKS = None


def ranks():
    global RANKS
    RANKS = RANKS or encoding.read_ranks(encoding.VOCABULARY)
    return RANKS


def test_encoding_equals_the_public_library():
    import tiktoken

    with open(encoding.VOCABULARY, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    own = tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=table, special_tokens={})
    encode = encoding.encoder(ranks())
    rng = random.Random(1)
    texts = ["", " ", "a" * 3000, "ү" * 700, "<|endoftext|>", "it's  \n\n tab\t 12,345 ₮ 临近中午 🙂👍🏽", "\r\nx​", "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(2000))]
    texts += ["".join(rng.choice("аригунzдүү  .1\n'") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    for t in texts:
        assert encode(t) == own.encode_ordinary(t)
        assert b"".join({v: k for k, v in table.items()}[i] for i in encode(t)[:50]) == t.encode()[: sum(len({v: k for k, v in table.items()}[i]) for i in encode(t)[:50])] if len(t) < 40 and rng.random() < 0.02 else True


def test_merge_takes_the_leftmost_of_equal_ranks():
    r = {b"a": 0, b"b": 1, b"aa": 2, b"aab": 3}
    assert encoding.merge_piece(b"aaa", r) == [2, 0]
    assert encoding.merge_piece(b"aaab", r) == [2, 0, 1]
    assert encoding.merge_piece(b"aab", r) == [3]


def test_encode_documents(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (1, "hello world")], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = sorted((r["doc_id"], list(r["ids"])) for r in encoding.encode_documents(df).collect())
    assert got[2:] == [(2, []), (3, [])] and got[0] == got[1] and len(got[0][1]) == 2
    assert encoding.encode_documents(df.limit(0)).count() == 0


WORDS = [f"{a}{b}" for a in "бол сар уул гол мод тал хан дов".split() for b in "ын гийн аас руу тай гүй".split()]


def _text(rng, n):
    return [rng.choice(WORDS) + rng.choice(["", "", "л", "х"]) + str(rng.randrange(40)) for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(7)
    items = [(k, " ".join(_text(rng, 60))) for k in range(12)]
    docs, want = [], set()
    for k in range(80):
        body = _text(rng, 120)
        if k % 2:
            item = k % 12
            words = items[item][1].split()
            n = rng.choice([12, 15, 22, 30, 50])
            at = rng.randrange(60 - n + 1)
            run = words[at : at + n]
            if n >= 22:
                for j in range(4, n - 4, 11):
                    run[j] = "өөр"
                want.add((k, item))
            body[40:40] = [w.upper() + rng.choice(["", ",", "."]) for w in run]
        docs.append((k, "\n".join(" ".join(body[i : i + 20]) for i in range(0, len(body), 20))))
    docs += [(900, None), (901, ""), (902, "богино"), (1, docs[1][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("itemid", F.lit(5))
    e = spark.createDataFrame(items + [(50, None), (51, "")], "itemid long, passage string")
    assert {tuple(r) for r in leakage.leaked(d, e).collect()} == want
    assert leakage.leaked(d, e.limit(0)).count() == 0 and leakage.leaked(d.limit(0), e).count() == 0


def test_candidates_against_brute_force():
    """Recall of the bands over pairs that the exact check accepts."""
    rng = random.Random(11)
    items = [(k, " ".join(_text(rng, 50))) for k in range(30)]
    probe = leakage.build_probe(items)
    found = total = 0
    for k, (item, passage) in enumerate(items):
        words = passage.split()
        run = words[5:27]
        run[7] = run[15] = "өөр"
        text = " ".join(_text(rng, 30) + run + _text(rng, 30))
        seq = leakage.streams(text)["w"]
        for other in probe.symbols:
            if leakage.longest_run(seq, probe.symbols[other], 1) >= leakage.WORDS:
                total += 1
                found += (0, other) in leakage._candidates(probe, "w", [seq])
    assert total >= 30 and found >= 0.95 * total


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(3)
    items = [(k, " ".join(_text(rng, 40))) for k in range(5)]
    d = spark.createDataFrame([(k, p) for k, p in items], "doc_id long, text string")
    e = spark.createDataFrame(items, "itemid long, passage string")
    whole = {tuple(r) for r in leakage.leaked(d, e).collect()}
    monkeypatch.setattr(leakage, "BLOCK_WINDOWS", 300)
    assert {tuple(r) for r in leakage.leaked(d, e).collect()} == whole == {(k, k) for k in range(5)}


@pytest.mark.parametrize("a, b", [("1 566 180 төгрөг", "1,566,180 Төгрөг"), ("2025/6/4 өдөр", "2025-06-04 өдөр"), ("нoмингoo", "номингоо"), ("ﬁne ＡＢ", "fine ab"), ("эр​х", "эрх")])
def test_writing_does_not_count(a, b):
    assert np.array_equal(leakage.streams(a)["w"], leakage.streams(b)["w"])


SENTENCES = {
    "en": "The holder of the account closed the savings book and nobody checked the identity card.",
    "de": "Der Inhaber des Kontos hat das Sparbuch aufgelöst und niemand hat den Ausweis geprüft.",
    "ru": "Владелец счёта закрыл сберегательную книжку и никто не проверил удостоверение.",
    "mn": "Дансны эзэмшигч хадгаламжийн дэвтрээ хааж хэн ч үнэмлэхийг нь шалгаагүй байна.",
    "kk": "Шоттың иесі жинақ кітапшасын жауып ешкім жеке куәлікті тексермеді деп жазылған.",
    "zh": "账户的持有人注销了储蓄存折，没有人核对身份证件，凭证上也没有盖章。",
}


def test_languages(spark):
    rng = random.Random(2)
    rows = []
    for k in range(240):
        lang = rng.choice(list(SENTENCES))
        text = SENTENCES[lang] + f" {rng.randrange(1000)}"
        rows.append((k, text, lang if rng.random() < 0.85 else rng.choice(["en", None, "und", "bg"])))
    rows += [(500, f"{SENTENCES['en']}\r\n\n  \n{SENTENCES['ru']}", "en"), (501, None, "en"), (502, "", None), (503, " \n ", "mn"), (504, SENTENCES["mn"], "mon"), (505, SENTENCES["zh"], "ja")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("confidence", F.lit(1))
    got = {(r["doc_id"], r["segment_no"]): r for r in languages.identify(df).collect()}
    truth = {(k, 1): next(c for c, s in SENTENCES.items() if t.startswith(s)) for k, t, _ in rows if k < 240}
    assert sum(got[k]["lang"] == v for k, v in truth.items()) >= 0.99 * len(truth)
    assert (got[500, 1]["lang"], got[500, 2]["lang"], got[500, 1]["label_ok"]) == ("en", "ru", False)
    assert got[504, 1]["label_ok"] and not got[505, 1]["label_ok"] and not {501, 502, 503} & {k for k, _ in got}
    assert all(0 < r["confidence"] <= 1 for r in got.values())
    assert languages.identify(df.limit(0)).count() == 0


@pytest.mark.parametrize("label, code", [("mn-MN", "mn"), ("KAZ", "kk"), ("zh_CN", "zh"), ("??", None), ("", None), (None, None), ("und", None), ("nl", "other")])
def test_labels(label, code):
    assert languages.stated(label) == code
