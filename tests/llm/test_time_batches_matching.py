"""Problems 4, 6 and 7."""

import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from moneytrail.llm import batches, matching, names, nearest
from moneytrail.operators import components


def brute(left, right, tol):
    out = set()
    for i, e, t in left:
        if e is None or t is None:
            continue
        best = min(((abs(t - u), j) for j, f, u in right if f == e and u is not None), default=None)
        if best and best[0] <= tol:
            out.add((i, best[1]))
    return out


@pytest.mark.parametrize("hot, cuts", [(None, 0), (10, 256), (3, 4)])
def test_nearest_against_brute_force(spark, hot, cuts, monkeypatch):
    if hot:
        monkeypatch.setattr(nearest, "HOT", hot)
        monkeypatch.setattr(nearest, "CUTS", cuts)
    rng = random.Random(2)
    us = lambda: rng.choice([None, rng.randrange(0, 86_400) * 1_000_000, rng.randrange(86_400 * 40) * 500_000]) if rng.random() < 0.9 else 1_000_000_000
    ent = lambda: rng.choice([1, 1, 1, 2, 3, None])
    left = [(k, ent(), us()) for k in range(400)]
    right = [(k, ent(), us()) for k in range(300)]
    cols = "id long, entity long, us long"
    a, b = spark.createDataFrame(left, cols).withColumn("cell", F.lit("clash")), spark.createDataFrame(right + right[:20], cols)
    got = {tuple(r) for r in nearest.nearest_in_time(a, b, 1800).collect()}
    assert got == brute(left, right, 1_800_000_000)
    assert nearest.nearest_in_time(a.limit(0), b, 1800).count() == 0
    assert nearest.nearest_in_time(a, b.limit(0), 1800).count() == 0


T0, T1 = dt.datetime(2020, 1, 1, 10), dt.datetime(2021, 1, 1, 10)
RECORDS = [
    (1, 1, "001722154091", "Уулзвар банк", "Дуламж Мошүнлон", T0), (2, 1, "001722154091", "Салхи банк", "Дуламж Мошүнлон", T1), (3, 1, "данс: 001722154091", None, "Д. Мошүнлон", T0),
    (4, 2, "MN590005001722154091", "УУЛЗВАР БАНК", "ДУЛАМЖ МОШҮНЛОН", T0), (5, 2, "001722154901", "Уулзвар", "Дуламж Мошүнлон", T0), (6, 2, "001722154092", "Уулзвар банк", "Дуламж Мошүнлон", T1),
    (7, 3, "00l722l5409l", "Uulzvar bank", "Dulamj Moshunlon", None), (8, 3, None, "Уулзвар банк", "Дуламж Мошүнлон", T0), (9, 3, "001722154091.0", "Уулзвар банк", "Аригун Бомчургам", T1), (10, None, "5", None, None, None),
]
RECORD_COLS = "id long, batchNo long, accountNumber string, bankName string, ownerName string, firstTxn timestamp_ntz"


def test_repeats(spark):
    df = spark.createDataFrame(RECORDS + RECORDS[:1], RECORD_COLS).withColumn("cell", F.lit(1))
    got = {tuple(r) for r in batches.repeats(df).collect()}
    assert got == {(1, 3), (1, 4), (1, 5), (1, 7)}
    assert batches.repeats(df.limit(0)).count() == 0


def test_long_account_numbers_keep_all_digits(spark):
    c = spark.createDataFrame([("0012345678901234567",), ("9912345678901234567",), ("MN590005001722154091",), ("DE89370400440532013000",), ("0",), ("-",), (None,)], "a string")
    got = [r[0] for r in c.select(batches.account_digits(F.col("a"))).collect()]
    assert got == ["12345678901234567", "9912345678901234567", "1722154091", "370400440532013000", "0", None, None]


def _vectors(rng, n):
    rows = []
    for k in range(1, n + 1):
        if k > 40 and rng.random() < 0.7:
            d, since = rows[rng.randrange(len(rows))][1:3]
            x, i = list(d), rng.randrange(len(d))
            if rng.random() < 0.5:
                x[i] = str(rng.randrange(10))
            else:
                j = min(i + 1, len(d) - 1)
                x[i], x[j] = x[j], x[i]
            d = "".join(x).lstrip("0") or "0"
        else:
            d, since = "".join(str(rng.randrange(10)) for _ in range(rng.choice([3, 12, 12, 17]))).lstrip("0") or "0", k
        rows.append((k, d, since, "F|o|p", "b"))
    return rows


def test_cells_lose_nothing(spark, tmp_path):
    """Links by probed cells against a comparison of all pairs; numbers of several lengths."""
    rows = _vectors(random.Random(4), 300)
    v = spark.createDataFrame(rows, batches.VECTORS)
    index = batches.CellIndex.create(spark, str(tmp_path / "i"), 50_000)
    assert index.meta["lead"] == 3
    got = {frozenset((r["id"], r["match"])) for r in index.links(v, v.withColumnRenamed("id", "match")).collect()}

    def fits(a, b):
        n = max(len(a), len(b))
        a, b = a.rjust(n, "0"), b.rjust(n, "0")
        diff = [i for i in range(n) if a[i] != b[i]]
        return len(diff) <= 1 or (len(diff) == 2 and diff[1] == diff[0] + 1 and a[diff[0]] == b[diff[1]] and a[diff[1]] == b[diff[0]])

    want = {frozenset((a[0], b[0])) for a in rows for b in rows if a[0] != b[0] and (a[1] == b[1] or (a[2] == b[2] and fits(a[1], b[1])))}
    assert len(want) > 200 and got == want


def _batch(spark, rng, size, first_id):
    """Accounts never seen and, one in four, repeats of those of 100,000 to 100,019."""
    rows = []
    for k in range(size):
        no = 100_000 + rng.randrange(20) if k % 4 == 0 else rng.randrange(10**11, 10**12)
        rows.append((first_id + k, str(no), "Уулзвар банк", f"Аригун Зүдмүг{'абвгдежзик'[no % 10]}{'лмнопрстуф'[no // 10 % 10]}", T0 + dt.timedelta(hours=no % 1000)))
    return spark.createDataFrame(rows, "id long, accountNumber string, bankName string, ownerName string, firstTxn timestamp_ntz")


def test_an_index_is_opened_again_and_gives_the_same(spark, tmp_path):
    rng = random.Random(9)
    parts = [_batch(spark, rng, 60, 1 + 1000 * k) for k in range(4)]
    one = batches.CellIndex.create(spark, str(tmp_path / "one"), 60)
    for p in parts:
        one.add(p)
    batches.CellIndex.create(spark, str(tmp_path / "two"), 1, shard_bytes=40)
    for p in parts:  # a file laid out anew on the way, and opened for each batch
        batches.CellIndex.open(spark, str(tmp_path / "two")).add(p)
    two = batches.CellIndex.open(spark, str(tmp_path / "two"))
    assert two.meta["layout"] > 0 and two.meta["shard"] > one.meta["shard"]
    want = {tuple(r) for r in one.repeats().collect()}
    assert len(want) > 20 and {tuple(r) for r in two.repeats().collect()} == want
    whole = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).withColumn("batchNo", F.lit(1))
    assert {tuple(r) for r in batches.repeats(whole).collect()} == want


def test_a_lost_batch_is_not_read(spark, tmp_path):
    index = batches.CellIndex.create(spark, str(tmp_path / "i"), 10)
    rng = random.Random(2)
    index.add(_batch(spark, rng, 8, 1))
    lost = batches.CellIndex.open(spark, index.path)
    lost._commit = lambda: None
    lost.add(_batch(spark, rng, 8, 100))
    again = batches.CellIndex.open(spark, index.path)
    assert again.labels().count() == 8 and again.stored().count() == len({r["digits"] for r in again.stored().collect()})


def test_what_a_batch_reads_does_not_grow_with_history(spark, tmp_path):
    """A batch in few cells, added to a short and to a ten times longer history: the stored vectors read."""
    rng = random.Random(3)
    read, shards = [], []
    for n in (3000, 30_000):
        rows = [(k, str(rng.randrange(10**11, 10**12)), k, "F|arigon|zodmogcag", "b") for k in range(n)]
        index = batches.CellIndex.create(spark, str(tmp_path / f"i{n}"), n, shard_bytes=120)
        index._append(index._vectors(spark.createDataFrame(rows, batches.VECTORS).withColumnRenamed("id", "label")), "first")
        mine = spark.createDataFrame([(10**6, "123456123456", 5, "F|arigon|zodmogcag", "b")], batches.VECTORS)
        found = index.probed(mine).agg(F.count("*"), F.count_distinct("shard")).first()
        read.append(found[0])
        shards.append(found[1])
    assert read[1] < 2 * read[0] < 3000 and max(shards) <= 40


def test_logistic_separates_and_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))
    y = (rng.random(3000) < p).astype(float)
    w, scale, shift = matching.fit_calibrated(x, y)
    q = 1 / (1 + np.exp(-((np.hstack([x, np.ones((3000, 1))]) @ w) * scale + shift)))
    assert abs(q.mean() - y.mean()) < 0.03 and abs(q - p).mean() < 0.05


def test_minhash_bands_meet():
    same = set(matching.token_bands(names.token("зүдмүгцаг"))) & set(matching.token_bands(names.token("zudmugtsag")))
    assert len(same) == matching.BANDS
    assert set(matching.token_bands("zudmugcag")) & set(matching.token_bands("zudmugag"))


def test_match(spark):
    cols = "id string, name string, aliases string, listed array<string>, births array<string>, country string"
    left = spark.createDataFrame([("1", "Аригун Зүдмүгцаг", None, None, ["1966-09-09"], "mn"), ("2", "Дуламж Бомчургам", "Их Лүдбүжир", None, [], None), ("3", None, None, None, None, None), ("1", "Аригун Зүдмүгцаг", None, None, ["1966-09-09"], "mn")], cols)
    right = spark.createDataFrame([("a", None, None, ["Arigun Zudmugtsag"], ["1966"], "MN"), ("b", None, None, ["Arigun Zudmugtsag"], ["1980-01-01"], "mn"), ("c", None, None, ["Хар Лүдбүжир"], [], "ru"), ("d", None, None, None, None, None)], cols)
    none = spark.createDataFrame([], "a string, b string, y boolean")
    assert matching.match(left, right, none).count() == 0  # nothing to learn from
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("бгдзклмнрстхцш" if k % 2 else "аөиэу") for k in range(n))
    more = [(str(k), f"{word(7)} {word(8)}", None, None, [f"{rng.randrange(1950, 2000)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}"], "mn") for k in range(10, 60)]
    left = left.union(spark.createDataFrame(more, cols))
    same = [(f"s{i}", None, None, [n], b if k % 4 else ["2001-03-03"], c) for k, (i, n, _, _, b, c) in enumerate(more)]
    right = right.union(spark.createDataFrame(same, cols))
    want = {("1", "a"), ("2", "c")} | {(r[0], s[0]) for r, s in zip(more, same) if r[4] == s[4]}
    # weak labels alone, and with reviewed pairs
    assert {(r["a"], r["b"]) for r in matching.match(left, right, none).collect()} >= want - {("1", "a"), ("2", "c")}
    labels = spark.createDataFrame([(r[0], s[0], r[4] == s[4]) for r, s in zip(more, same)] + [("1", "a", True), ("1", "b", False), ("2", "c", True)], none.schema)
    assert {(r["a"], r["b"]) for r in matching.match(left, right, labels).collect()} == want
    assert matching.match(left.limit(0), right, labels).count() == 0
    assert matching.compare_births(["1966-09-09"], ["1966-09-09"])[0] == 1 and matching.compare_births([], ["1966"])[-1] == 1


def test_candidates_of_common_and_short_tokens_are_all_that_fit(spark):
    """A third of all names bear one family name, tokens go down to an initial: against all pairs."""
    rng = random.Random(3)
    syl = ["зүд", "мүг", "цаг", "бом", "чур", "гам", "лөн", "шиг", "тол", "нор"]
    given = ["аригун", "дуламж", "билгээн", "бат", "ану", "жавхаа"]
    people = ["".join(rng.choice(syl) for _ in range(3)) if k % 3 else "зүдмүгцаг" for k in range(300)]
    rows = [(str(k), names.parse(f"{rng.choice(given)}{rng.choice(['', '', *syl])} {f}")) for k, f in enumerate(people)]
    rows += [(f"i{k}", names.parse(f"{g} зүдмүгцаг")) for k, g in enumerate(["а", "д", "билка", "ба", "жавхай"])] + [("n1", names.parse("их лүдбүжир")), ("n2", names.parse("бат"))]
    side = spark.createDataFrame([(i, [names.joined(n)], None) for i, n in rows], "id string, names array<string>, births array<string>")
    got = {tuple(r) for r in matching.candidates(side, side).collect()}
    fits = lambda m, n: m[0] == n[0] and (names.same_token(m[1][0], n[1][0]) if m[0] == "N" else names.same_name(m[1], n[1]) > 0)
    near = {(i, j) for i, m in rows for j, n in rows if fits(m, n)}
    assert {(i, j) for i, m in rows for j, n in rows if m == n} <= got
    assert got <= near
    assert got == near


def test_candidates_by_birth_date_bear_a_misspelt_token(spark):
    left = spark.createDataFrame([("1", ["F|arigon|zodmogcag"], ["1966-09-09"])], "id string, names array<string>, births array<string>")
    right = spark.createDataFrame([("a", ["F|arigon|zoodnocak"], ["1966-09-09"]), ("b", ["F|arigon|zoodnocak"], ["1966-09"]), ("c", ["F|dolamj|zoodnocak"], ["1966-09-09"])], left.schema)
    assert {tuple(r) for r in matching.candidates(left, right).collect()} == {("1", "a")}


@pytest.mark.parametrize("length", range(3, 17))
def test_planted_errors_meet(length):
    """Every spelling with one planted error that the comparison accepts shares a key, in one script and across both."""
    rng = random.Random(length)
    lost, tried = 0, 0
    for _ in range(150):
        w = "".join(rng.choice("бгдзклмнрстхцшя" if k % 2 else "аеиоөүэу") for k in range(length))
        i = rng.randrange(length - 1)
        for v in (w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + rng.choice("бгдаео") + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + rng.choice("бгдаео") + w[i:]):
            for a, b in ((names.token(w), names.token(v)), (names.token(w), names.folded(names.token(v))), (names.folded(names.token(w)), names.folded(names.token(v)))):
                if names.same_token(a, b):
                    tried += 1
                    lost += not set(matching.token_keys(a)) & set(matching.token_keys(b))
    assert tried > 20 and lost <= (0.002 * tried if length >= matching.LONG else 0)


def test_nearest_frame_function_on_empty_sides():
    e = pd.DataFrame({"id": [], "entity": [], "us": [], "span": []})
    assert nearest._nearest(e, e, 5).empty


def test_crowds_and_few_with_one_first_transaction_give_the_same(spark, tmp_path, monkeypatch):
    """Cells are probed for crowds only, and all that lies within one error is linked either way."""
    rng = random.Random(12)
    digits = ["".join(rng.choice("0123456789") for _ in range(8)).lstrip("0") for _ in range(30)]
    digits += [d[:k] + rng.choice("0123456789") + d[k + 1 :] for d in digits for k in (0, 3, 6)] + [d[:5] + d[6] + d[5] + d[7:] for d in digits if len(d) == 8]
    rows = [(k, d, k % 2, "N|bat", "bank") for k, d in enumerate(dict.fromkeys(digits))]
    v = spark.createDataFrame(rows, "id long, digits string, since long, owner string, bank string")
    def near(p, q):
        wrong = [i for i in range(8) if p[i] != q[i]]
        return len(wrong) == 1 or (len(wrong) == 2 and wrong[1] == wrong[0] + 1 and p[wrong[0]] == q[wrong[1]] and p[wrong[1]] == q[wrong[0]])

    want = {(a[0], b[0]) for a in rows for b in rows if a[2] == b[2] and near(a[1].zfill(8), b[1].zfill(8))}
    probed = []
    plain = batches._probes
    monkeypatch.setattr(batches, "_probes", lambda v, lead: (probed.append(1), plain(v, lead))[1])
    for crowd in (100, 1):
        monkeypatch.setattr(batches, "CROWD", crowd)
        index = batches.CellIndex.create(spark, str(tmp_path / f"i{crowd}"), 5000)
        right = v.select(F.col("id").alias("match"), *batches.VECTOR)
        assert {tuple(r) for r in index.links(v, right).collect()} == want
        assert bool(probed) == (crowd == 1)
    assert len(want) > 50


def test_small_batches_are_compared_in_one_task_and_give_the_same(spark, tmp_path, monkeypatch):
    """Few jobs a batch, each of which would leave its threads, plans and broadcasts in the driver for a while."""
    rng = random.Random(9)
    parts = [_batch(spark, rng, 60, 1 + 1000 * k) for k in range(3)]
    found, jobs = [], []
    for few in (batches.FEW_BYTES, -1):
        monkeypatch.setattr(batches, "FEW_BYTES", few)
        monkeypatch.setattr(components, "FEW_BYTES", few)
        index = batches.CellIndex.create(spark, str(tmp_path / f"i{few}"), 60)
        for k, p in enumerate(parts):
            spark.sparkContext.setJobGroup(f"{few} {k}", "")
            index.add(p)
            jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{few} {k}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        found.append({tuple(r) for r in index.repeats().collect()})
    assert len(found[0]) > 20 and found[0] == found[1]
    assert max(jobs[1:3]) <= 14 < min(jobs[4:])  # the first batch also makes an empty table


def test_candidates_are_written_before_they_are_compared(spark):
    """Else the driver holds the shuffles of all steps from the names on until the features are done."""
    side = spark.createDataFrame([("1", ["F|arigon|zodmogcag"], ["1966-09-09"])], "id string, names array<string>, births array<string>")
    found = matching.candidates(side, side)
    assert [tuple(r) for r in found.collect()] == [("1", "1")]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
