"""Account statistics, rules and patterns on small ledgers with known answers."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from moneytrail.operators import casework, ledger, network, rules

SCHEMA = "id long, acct long, ts timestamp_ntz, amount decimal(18,2), amt double, type string, category string, description string, ref string, cp string, cp_name string, cp_nat string, channel string, location string, currency string, flagStatus string"


def frame(spark, rows):
    out = []
    for i, (acct, ts, amount, kind, cp) in enumerate(rows, 1):
        out.append((i, acct, dt.datetime.fromisoformat(ts), Decimal(amount), float(amount), kind, None, None, None, cp, None, None, None, None, "MNT", "NORMAL"))
    return spark.createDataFrame(out, SCHEMA)


@pytest.fixture
def seed(spark):
    """The structuring week, smurfing day and night burst of the seed scenario."""
    rows = [(1, f"2026-03-02T{9 + k:02d}:00:00", "2400000" if k < 3 else "2300000", "credit", f"90{k}") for k in range(4)]
    rows += [(1, f"2026-03-{9 + k:02d}T10:00:00", "7500000", "debit", "5001234002") for k in range(3)]
    rows += [(1, f"2026-03-15T02:{2 * k:02d}:00", "1700000", "debit", "77") for k in range(5)]
    return frame(spark, rows)


def test_rules_of_the_seed(seed):
    fired = {r["rule"]: r for r in rules.violations(seed).collect()}
    assert {1, 3, 7, 11} <= set(fired)
    assert fired[1]["what"] == "5" and fired[3]["what"] == "5001234002" and fired[11]["what"] == "4"
    s = rules.rule_scores(seed).first()
    assert s["action"] == "BLOCK" and s["final_score"] == 1.0
    assert rules.rule_features(seed).first()["r3"] == 1


def test_velocity_needs_six_or_the_last_five(spark):
    six = frame(spark, [(1, f"2026-01-01T10:0{k}:00", "10", "debit", "a") for k in range(6)] + [(1, "2026-02-01T00:00:00", "10", "debit", "a")])
    assert rules.velocity(six).first()["what"] == "6"
    slow = frame(spark, [(1, f"2026-01-0{k + 1}T10:00:00", "10", "debit", "a") for k in range(6)])
    assert rules.velocity(slow).count() == 0


def test_statistics(spark):
    l = frame(spark, [(1, "2026-01-05T10:00:00", "100", "credit", "a"), (1, "2026-01-05T10:30:00", "50", "debit", "b"), (1, "2026-01-06T11:00:00", "30.50", "debit", None)])
    r = ledger.account_statistics(l).first()
    assert (r["n"], r["total"], r["median"], r["credits"], r["debits"], r["peak_hour"], r["peak_day"]) == (3, 180.5, 50.0, 100.0, 80.5, 10, 1)
    assert r["debit_credit_ratio"] == 0.805
    assert ledger.account_statistics(l.limit(0)).count() == 0
    assert [x["n"] for x in ledger.hourly_distribution(l).orderBy("hour").collect()][10] == 2
    assert ledger.hourly_distribution(l.limit(0)).count() == 24


@pytest.mark.parametrize("value, digit", [("0.50", 0), ("1", 1), ("999", 9), ("1000", 1), ("-42", 4)])
def test_leading_digit(spark, value, digit):
    df = spark.createDataFrame([(Decimal(value),)], "amount decimal(18,2)")
    assert df.select(ledger.leading_digit()).first()[0] == digit


def test_benford_of_few_digits_passes(spark):
    l = frame(spark, [(1, "2026-01-01T00:00:00", "9", "debit", None)] * 3)
    r = ledger.benford_test(l).first()
    assert r["passes"] and r["p_value"] == 1.0 and r["chi_square"] == 0.0


def test_night_and_off_hours_differ_at_six(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 1, 6),)], "ts timestamp_ntz")
    r = df.select(ledger.off_hours().alias("off"), ledger.night_hour().alias("night"), ledger.night_hour(22, 5).alias("wrap")).first()
    assert (r["off"], r["night"], r["wrap"]) == (False, True, False)


def test_burst_restarts_after_a_hit(spark):
    rows = [(k, "1", "2", dt.datetime(2026, 3, 20, 21, 4 * k), 1) for k in range(5)] + [(9, "1", "2", dt.datetime(2026, 3, 20, 21, 21), 1)]
    calls = spark.createDataFrame(rows, "id long, callerNumber string, calledNumber string, startTime timestamp_ntz, suspectId long")
    r = rules.pattern_burst(calls).collect()
    assert len(r) == 1 and r[0]["at"] == "2026-03-20 21:00:00" and r[0]["what"] == str(16 * 60_000_000)


def test_round_trip_rule_and_pattern(spark):
    l = frame(spark, [(1, "2026-01-01T00:00:00", "1000", "credit", "a"), (1, "2026-01-02T00:00:00", "1040", "debit", "b"), (1, "2026-01-03T00:00:00", "1050", "debit", "b")])
    assert rules.round_trip(l).first()["what"] == "1"
    got = rules.pattern_round_trip(l).collect()
    assert [r["what"] for r in got] == ["1"]


def test_placeholders_and_relations(spark):
    df = spark.createDataFrame([("-",), ("--",), ("N/A",), ("null",), (". .",), ("тодорхойгүй",), ("A-1",), (None,)], "c string")
    assert [r[0] for r in df.select(network.cleaned("c")).collect()] == [None] * 6 + ["A-1", None]


def test_bag_except_keeps_multiplicity(spark):
    new = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, None), (6, None)], "id long, k string")
    stored = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    got = sorted((r["id"]) for r in casework.bag_except(new, stored, ["k"]).collect())
    assert got == [3, 4, 6]


def test_audit_chain_breaks_where_edited(spark):
    e = spark.createDataFrame([(1, k, "t", "me", "act", None, f"d{k}") for k in range(1, 6)], "chain long, id long, at string, actor string, action string, target string, detail string")
    c = casework.audit_chain(e)
    assert casework.audit_verify(c).first()["first_bad"] is None
    bad = c.withColumn("p", F.when(F.col("id") == 3, "x").otherwise(F.col("p")))
    assert casework.audit_verify(bad).first()["first_bad"] == 3


def test_audit_verify_covers_the_whole_ledger(spark):
    from moneytrail.registry import Tables, _audit

    t = Tables(spark, "/root/testdata/sf0.001")
    assert _audit(t).agg(F.sum("events")).first()[0] == t.ledger.count()


def test_screening_ladder(spark):
    p = spark.createDataFrame([(1, "kim jong un", None, "kp"), (2, "Lukashenka", None, "xx"), (3, "nobody here", "", None)], "id long, fullName string, aliases string, country string")
    e = spark.createDataFrame([("E1", None, ["Kim Jong Un"], None, "KP"), ("E2", "x", ["Alexander Lukashenka"], [], "BY"), ("E3", None, None, None, None), ("E4", "KIM JONG UN", None, None, "KP")], "id string, caption string, names array<string>, aliases array<string>, country string")
    got = {(r["suspect"], r["entry"]): r["score"] for r in casework.screening(p, e).collect()}
    assert got == {(1, "E1"): 1.0, (2, "E2"): 0.85, (1, "E4"): 1.0}


def test_screening_tests_the_tokens_of_the_person_only(spark):
    p = spark.createDataFrame([(1, "Bold Temur", None, None)], "id long, fullName string, aliases string, country string")
    e = spark.createDataFrame([("two", "Bald Temor"), ("tokens", "xBold Temurx yy"), ("part", "Temur"), ("none", "Balt Temor x")], "id string, caption string")
    e = e.selectExpr("id", "caption", "cast(null as array<string>) as names", "cast(null as array<string>) as aliases", "cast(null as string) as country")
    got = {r["entry"]: r["score"] for r in casework.screening(p, e).collect()}
    assert got == {"two": 0.55, "tokens": 0.85, "part": 0.7}


def test_screening_against_all_pairs(spark):
    """Edits in the first and last third, a letter added at a change of length, containment without an equal token."""
    import random

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abdegiklmnorstu") for _ in range(n))
    left, right = ["abcdefgh", "xbcdefgy", "kim jong un"], ["abcdefghi", "abcdefgh", "superabcdefghland", "kimm jongg unn"]
    for _ in range(40):
        w = word(rng.randint(4, 9)) + rng.choice(["", " " + word(4)])
        left.append(w)
        for _ in range(2):
            v = list(w)
            for _ in range(rng.randint(1, 2)):
                i = rng.randrange(len(v))
                v[i : i + 1] = rng.choice([[], [v[i], "q"], ["q"]])
            right.append("".join(v))
        right.append(word(2) + w + word(1))
    p = spark.createDataFrame([(k, w, None, None) for k, w in enumerate(left)], "id long, fullName string, aliases string, country string")
    e = spark.createDataFrame([(str(k), None, [w], None, None) for k, w in enumerate(right)], "id string, caption string, names array<string>, aliases array<string>, country string")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    def score(a, b):
        a, b = a.strip(), b.strip()
        if min(len(a), len(b)) < 3:
            return None
        if a == b:
            return 1.0
        if all(t in b for t in a.split()):
            return 0.85
        if a in b or b in a:
            return 0.7
        return 0.55 if edits(a, b) <= 2 else None

    want = {(i, str(j)): s for i, a in enumerate(left) for j, b in enumerate(right) if (s := score(a, b))}
    assert {(r["suspect"], r["entry"]): r["score"] for r in casework.screening(p, e).collect()} == want


def test_entities_join_by_any_key(spark):
    s = spark.createDataFrame([(1, "A  B", "N1", None), (2, "a b", None, None), (3, "c", "N1", "+976 9911-2233"), (4, "d", "N9", "99112233"), (5, "e", " ", "12345")], "id long, fullName string, nationalId string, primaryPhone string")
    got = dict((r["id"], r["person"]) for r in network.entity_components(s).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


def test_merge_renumbers_after_the_target(spark):
    e = spark.createDataFrame([("T", 1, 10), ("T", 4, 11), ("A", 2, 20), ("A", 1, 21), ("B", 1, 20), ("B", 2, 22)], "caseId string, exhibit long, id long")
    got = dict((r["id"], r["exhibit"]) for r in casework.merge_renumber(e, "T").collect())
    assert got == {10: 1, 11: 4, 21: 5, 20: 6, 22: 7}
