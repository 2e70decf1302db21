"""Layout sniffing, profiles, readers, imports, scalar functions, model, streams, components."""

import datetime as dt
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from moneytrail.functions import scalars
from moneytrail.operators import components, imports, model
from moneytrail.operators.components import connected_components
from moneytrail.sources import profiles, readers, sinks
from moneytrail.streaming.windows import daily_flows


@pytest.mark.parametrize(
    "headers, found, confidence",
    [
        (["Гүйлгээний огноо", "Орлого", "Зарлага", "Үлдэгдэл"], "Mn-Split-Simple", "HIGH"),
        (["callstart", "callerid", "callednum"], "Call-Bill", "HIGH"),
        (["Гүйлгээний огноо", "Гүйлгээний дүн"], "Mn-Generic-Signed", "HIGH"),
        (["Гүйлгээний огноо", "Гүйлгээний дүн", "Цаг"], "Mn-16col-Signed", "LOW"),
        (["a", "b"], None, "LOW"),
    ],
)
def test_profiles(headers, found, confidence):
    p, _, c = profiles.detect(headers)
    assert (p and p.id, c) == (found, confidence)


def test_mapping_takes_the_first_known_header():
    p = next(x for x in profiles.PROFILES if x.id == "Call-Bill")
    assert profiles.mapping(p, ["Caller", "CALLED", "minut"], {"called": " ", "duration": "x"}) == {"caller": "Caller", "called": "CALLED", "duration": "x"}


@pytest.mark.parametrize("text, value", [("1,234.56", 1234.56), ("1.234,56", 1234.56), ("1,234", 1234.0), ("12,5", 12.5), ("₮ 2,000,000", 2e6), ("-500.5", -500.5), ("100.", 100.0), ("", 0.0), ("abc", 0.0), (None, 0.0)])
def test_clean_amount(spark, text, value):
    assert spark.createDataFrame([(text,)], "c string").select(scalars.clean_amount(F.col("c"))).first()[0] == value


@pytest.mark.parametrize("clock, out", [("2:05 PM", "14:05:00"), ("12:10 am", "00:10:00"), ("0.5", "12:00:00"), ("25:00", "00:00:00"), (None, "00:00:00")])
def test_time_of_day(spark, clock, out):
    us = int(dt.datetime(2026, 3, 1, tzinfo=dt.timezone.utc).timestamp() * 1e6)
    df = spark.createDataFrame([(us, clock)], "us long, c string").select(F.date_format(F.timestamp_micros(scalars.apply_time_of_day(F.col("us"), F.col("c"))), "HH:mm:ss"))
    assert df.first()[0] == out


def test_small_scalars(spark):
    df = spark.createDataFrame([("Bat <+976 9911-2233>", "FinancialTransfer", "[1,2]", "x")], "a string, b string, j string, k string")
    r = df.select(scalars.unwrap_caller(F.col("a")), scalars.canonical_enum(F.col("b"), ["UNKNOWN", "FINANCIAL_TRANSFER"]), scalars.json_ids(F.col("j")), scalars.json_ids(F.col("k")), scalars.money(F.lit(1234568.5))).first()
    assert list(r) == ["+97699112233", "FINANCIAL_TRANSFER", [1, 2], [], "₮ 1,234,569"]


def test_delimited_reader(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("﻿Тайлан\nOgnoo;Dun;Utga\n2026-01-01;5;\"a;b\"\n\n2026-01-02;;c\n", encoding="utf-8")
    df = readers.read_delimited(spark, str(f))
    assert [tuple(r) for r in df.orderBy("line").collect()] == [(3, "2026-01-01", "5", "a;b"), (5, "2026-01-02", None, "c")]


def test_watchlist_reader(spark, tmp_path):
    f = tmp_path / "w.jsonl"
    f.write_text('{"id":"1","names":["A"]}\n\nnot json\n{"id":"2","country":"mn","aliases":null}\n')
    got = {r["id"]: (r["names"], r["aliases"], r["country"]) for r in readers.read_watchlist(spark, str(f)).collect()}
    assert got == {"1": (["A"], [], ""), "2": ([], [], "mn")}


def test_workbook(tmp_path):
    f = tmp_path / "b.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S1" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>head</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    assert readers.workbook_sheets(str(f)) == ["S1"]
    assert readers.read_workbook(str(f)) == [["head", None, "2.5"], [], ["x"]]


def test_csv_sink_escapes(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([('say "hi", ok',)], "c string"), str(tmp_path / "o"))
    text = "".join(p.read_text() for p in (tmp_path / "o").glob("*.csv"))
    assert '"say ""hi"", ok"' in text


def test_bank_import_statuses(spark):
    rows = [
        (1, 1, {"date": "2026-01-01", "credit": "1,000.00", "debit": None, "account": "9", "reference": "R1"}),
        (1, 2, {"date": "2026-01-01", "credit": "", "debit": "-5", "account": "9", "reference": "R1"}),
        (1, 3, {"date": None, "credit": "1", "debit": None}),
        (1, 4, {"date": "2026-01-02", "credit": "0", "debit": "0"}),
        (1, 5, {"date": "2026-01-02", "credit": "7", "debit": None, "description": "Эхний үлдэгдэл"}),
    ]
    df = spark.createDataFrame(rows, "fileid long, lineno long, data map<string,string>")
    got = imports.import_bank(df)
    assert {r["lineno"]: r["status"] for r in got.collect()} == {1: "IMPORTED", 2: "DUPLICATE", 3: "SKIPPED", 4: "SKIPPED", 5: "SKIPPED"}
    assert tuple(imports.summary(got).first()) == (1, 5, 1, 3, 1)
    stored = got.where("status = 'IMPORTED'").select("ts_us", "type", "cents", "cp", "description")
    assert {r["status"] for r in imports.import_bank(df.where("lineno = 1"), stored).collect()} == {"DUPLICATE"}


def test_call_import_repeats_by_frequency(spark):
    rows = [(1, 1, {"caller": "a <99>", "called": "88", "duration": "1.5", "frequency": "3"}), (1, 2, {"caller": "99", "called": None})]
    got = imports.import_calls(spark.createDataFrame(rows, "fileid long, lineno long, data map<string,string>"), as_of_us=7).collect()
    assert [(r["caller"], r["seconds"], r["ts_us"]) for r in got] == [("99", 90, 7)] * 3


def test_model_and_auc(spark):
    w = model.train(np.array([[0.0], [1.0]]), np.array([0.0, 1.0]), epochs=300)
    assert model.predict(w, np.array([[1.0]]))[0] > 0.8 and np.isnan(model.predict(w, np.zeros((1, 3)))[0])
    s = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "score double, label int")
    assert model.auc(s).first()[0] == 0.875
    assert model.auc(s.where("label = 1")).first()[0] == 0.5


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (5, 5), (None, 3)], "a long, b long")
    got = dict((r["node"], r["component"]) for r in connected_components(e).collect())
    assert all(got[k] == 1 for k in range(1, 41)) and got[100] == got[101] == got[102] == 100 and len(got) == 43
    assert connected_components(e.limit(0)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(1, dt.datetime(2026, 1, d, 12), "credit" if d % 2 else "debit", float(d * 9_000_000)) for d in range(1, 6)]
    df = spark.createDataFrame(rows, "acct long, ts timestamp, type string, amount double")
    df.write.parquet(str(src))
    q = daily_flows(spark.readStream.schema(df.schema).parquet(str(src))).writeStream.format("memory").queryName("flows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r["acct"], r["day"], r["inflow"] or 0, r["outflow"] or 0, r["n"], r["mule"])
    assert sorted(map(key, spark.table("flows").collect())) == sorted(map(key, daily_flows(df).collect()))


@pytest.mark.parametrize("few", [-1, 1 << 20])
def test_components_by_rounds_and_in_one_task_are_the_same(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_BYTES", few)
    pairs = [(k + 1, k) for k in range(40)] + [(100, 90), (95, 100), (7, 7), (None, 3), (-5, 200), (200, 201)]
    e = spark.createDataFrame(pairs + pairs[:5], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(e).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 95: 90, 100: 90, -5: -5, 200: -5, 201: -5}
    assert components.connected_components(e.limit(0)).count() == 0
