"""Scopes, rankings, tagging and deletion on small cases: nulls, empty tables, ties."""

import pytest
from pyspark.sql import functions as F

from moneytrail.operators import casework, imports, network, reports

LEDGER = "id long, acct long, ts timestamp_ntz, type string, amount decimal(18,2), amt double, cp string, cp_name string, flagStatus string, location string"


def ledger(spark, rows):
    x = spark.createDataFrame(rows, "id long, acct long, ts string, type string, amount double, cp string, flagStatus string")
    return x.select("id", "acct", F.col("ts").cast("timestamp_ntz").alias("ts"), "type", F.col("amount").cast("decimal(18,2)").alias("amount"), F.col("amount").alias("amt"), "cp", "flagStatus", F.lit(None).cast("string").alias("location"))


@pytest.fixture(scope="module")
def tables(spark):
    l = ledger(spark, [(1, 1, "2024-01-01 10:00:00", "credit", 5e6, " B2 ", "SUSPICIOUS"), (2, 1, "2024-01-01 10:09:59", "debit", 2e6, None, "NORMAL"), (3, 1, "2024-01-01 10:10:01", "debit", 2e6, "", None), (4, 2, "2024-01-02 00:00:00", "credit", 3e6, "zzz", "NORMAL")])
    s = spark.createDataFrame([(10, "A B c", "UNDER_INVESTIGATION", "C1", "N1", "99112233"), (11, None, "CLEARED", "C2", "N1", None), (12, " x ", "CLEARED", None, None, None)], "id long, fullName string, status string, caseId string, nationalId string, primaryPhone string")
    a = spark.createDataFrame([(1, "B1", 10), (2, "B2", 11), (3, None, None)], "id long, accountNumber string, suspectId long")
    return l, s, a


def test_scope_is_a_union_of_ids(spark, tables):
    l, s, a = tables
    e = spark.createDataFrame([("C1", "TXN", 4), ("C2", "ACCOUNT", 3), ("C2", "SUSPECT", 11)], "caseId string, sourceType string, sourceId long")
    ids = lambda cases: {r["id"] for r in reports.evidence_scope(l, s, a, e, cases).collect()}
    assert ids(["C1"]) == {1, 2, 3, 4} and ids(["C2"]) == {4} and ids([]) == set() and ids(None) == {1, 2, 3, 4}
    own = spark.createDataFrame([(1, "C1")], "userId long, caseId string")
    assert reports.scoped_cases(own, own.limit(0), None).count() == 0 and reports.scoped_cases(own, own, 1).count() == 1 and reports.scoped_cases(own, own, 1, admin=True) is None


def test_qualification_and_drill_down(spark, tables):
    l, s, a = tables
    assert {r["id"] for r in reports.qualified_transfers(l, a, s, 1e6).collect()} == {1}
    assert {tuple(r)[:2] for r in reports.drill_down_rows(l).collect()} == {(1, 2)}
    assert reports.drill_down_rows(l.limit(0)).count() == 0


def test_person_columns(spark, tables):
    got = {r["id"]: (r["initials"], r["age"]) for r in reports.person_columns(tables[1], "2024-06-01", F.lit("2000-06-01").cast("date")).collect()}
    assert got == {10: ("AC", 24), 11: (None, 24), 12: ("X", 24)}


def test_tagging_twice_adds_nothing(spark):
    e = spark.createDataFrame([("C1", "TXN", 5, 3)], "caseId string, sourceType string, sourceId long, exhibit long")
    new = spark.createDataFrame([("C1", "TXN", 5), ("C1", "TXN", 6), ("C1", "TXN", 6), ("C2", "TXN", 6)], "caseId string, sourceType string, sourceId long")
    once = reports.tagged(e, new)
    assert {tuple(r) for r in once.collect()} == {("C1", "TXN", 5, 3), ("C1", "TXN", 6, 4), ("C2", "TXN", 6, 1)}
    assert reports.tagged(once, new).count() == 3


def test_deleting_a_case_keeps_shared_persons(spark, tables):
    l, s, a = tables
    calls = spark.createDataFrame([(1, 10), (2, None)], "id long, suspectId long")
    left = reports.delete_case(l, s, a, calls, "C1")
    assert left["suspects"].count() == 3  # the same national id is in another case
    left = reports.delete_case(l, s.where("id <> 11"), a, calls, "C1")
    assert [left[k].count() for k in ("suspects", "accounts", "transactions", "calls")] == [1, 2, 1, 1]


def test_shared_phones_link_all_owners(spark):
    s = spark.createDataFrame([(1, "99112233"), (2, "+976 99112233"), (3, "88110000"), (4, None)], "id long, primaryPhone string")
    c = spark.createDataFrame([(1, "99112233", "88110000", 10), (2, "88110000", "99112233", None), (3, None, "88110000", 1), (4, "99112233", "99112233", 1)], "id long, callerNumber string, calledNumber string, durationSeconds int")
    assert {tuple(r)[:4] for r in network.phone_links(c, s).collect()} == {(1, 3, 2, 10), (2, 3, 2, 10)}


def test_travel_ignores_letter_case(spark):
    l = ledger(spark, [(1, 1, "2024-01-01 10:00:00", "credit", 1.0, None, None)]).withColumn("location", F.lit("bayangol"))
    a = spark.createDataFrame([(1, 10)], "id long, suspectId long")
    c = spark.createDataFrame([(1, 10, "Bayangol"), (2, 10, "Darkhan")], "id long, suspectId long, location string").withColumn("startTime", F.lit("2024-01-01 11:00:00").cast("timestamp_ntz"))
    assert [(r["txn"], r["call"]) for r in network.travel_correlation(l, c, a).collect()] == [(1, 2)]


def test_numbers_in_parts_are_those_of_one_order(spark):
    df = spark.createDataFrame([(k,) for k in (3, 150, 7, 999, 42, 100)], "id long")
    got = sorted((r["id"], r["i"]) for r in network.numbered(df, "id", F.expr("id div 100"), "i").collect())
    assert got == [(k, i) for i, k in enumerate((3, 7, 42, 100, 150, 999))]


def test_references_repeat_after_an_import_only(spark):
    cell = lambda **k: {"date": "01/02/2024", "amount": "5", **k}
    rows = [
        (1, 1, cell(reference="r", account="a", description="Эхний үлдэгдэл")), (1, 2, cell(reference="r", account="a")), (2, 1, cell(reference="r", account="a", balance="10.5")),
        (2, 2, cell(reference="r")), (3, 1, cell(reference="r", balanceBefore="7", currency="usd")), (3, 2, None), (3, 3, {"date": None}), (4, None, None),
    ]
    got = imports.import_bank(spark.createDataFrame(rows, "fileid long, lineno long, data map<string,string>"))
    status = {(r["fileid"], r["lineno"]): r["status"] for r in got.collect()}
    assert status == {(1, 1): "SKIPPED", (1, 2): "IMPORTED", (2, 1): "DUPLICATE", (2, 2): "IMPORTED", (3, 1): "IMPORTED", (3, 2): "SKIPPED", (3, 3): "SKIPPED", (4, None): "SKIPPED"}
    one = got.where("fileid = 3 and lineno = 1").first()
    assert one["balance"] == 12.0 and one["currency"] == "USD"
    total = {r["fileid"]: (r["total"], r["imported"], r["skipped"], r["duplicate"]) for r in imports.summary(got).collect()}
    assert total[3] == (3, 1, 2, 0) and total[4] == (0, 0, 0, 0)


def test_dashboard_of_an_empty_scope(spark, tables):
    l, s, a = tables
    s = s.withColumn("riskLevel", F.lit("HIGH"))
    calls = spark.createDataFrame([(1, 10)], "id long, suspectId long")
    row = reports.scoped_dashboard(l, s, calls, a, []).first()
    assert row["transactions"] == 0 and row["first_at"] is None and row["suspects"] == 0
    assert casework.dashboard(l, s, calls, a).first()["transactions"] == 4
