"""Schema drift, times and rows that fail to parse."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from moneytrail.functions.times import read_birth, read_time, to_instant, to_second
from moneytrail.operators import normalise_times, parse_failures, schema_drift
from moneytrail.sources import delimited

SYSTEMS = [("ub", "Asia/Ulaanbaatar", "YMD"), ("berlin", "Europe/Berlin", "DMY"), ("ny", "America/New_York", "MDY"), ("syd", "Australia/Sydney", "DMY")]


@pytest.mark.parametrize(
    "text, source, out",
    [
        ("2024-09-04T03:50:28+08:00", "ub", "2024-09-03T19:50:28Z"),
        ("1753294861", "berlin", "2025-07-23T18:21:01Z"),
        ("1727608577403", "berlin", "2024-09-29T11:16:17Z"),
        ("20241212003115", "syd", "2024-12-11T13:31:15Z"),
        ("13-02-24 22:31", "syd", "2024-02-13T11:31:00Z"),
        ("2024 оны 5 сарын 25, 22:42:00", "ub", "2024-05-25T14:42:00Z"),
        ("06/10/2023 11:28:05 PM", "berlin", "2023-10-06T21:28:05Z"),
        ("07/29/2024 08:29:02", "ny", "2024-07-29T12:29:02Z"),
        ("2022-06-28T12:45:55 [Asia/Ulaanbaatar]", "berlin", "2022-06-28T04:45:55Z"),
        ("10 Dec 2023 05:40:34 UTC", "ub", "2023-12-10T05:40:34Z"),
        ("Mon, 17 Jul 2023 18:34:31 +0530", "ub", "2023-07-17T13:04:31Z"),
        ("Oct 23, 2024 9:04:00 pm", "ub", "2024-10-23T13:04:00Z"),
        ("45228.06921296", "berlin", "2023-10-28T23:39:40Z"),
        ("20250123T090715+0800", "ny", "2025-01-23T01:07:15Z"),
        ("2022-06-28T05:23:30.920355Z", "ny", "2022-06-28T05:23:31Z"),
        ("2023-10-29 02:30:00", "berlin", "2023-10-29T00:30:00Z"),  # twice: the earlier
        ("2023-03-26 02:30:00", "berlin", "2023-03-26T01:30:00Z"),  # skipped: the offset before
        ("31.11.2023 09:10", "berlin", None),
        ("2023-13-05 08:00", "ub", None),
        ("25:71", "ub", None),
        ("", "ub", None),
        (None, "ub", None),
        ("2024-01-01 10:00:00 GIBBERISH", "ub", None),
    ],
)
def test_times(spark, text, source, out):
    zone, order = {s: (z, o) for s, z, o in SYSTEMS}[source]
    p = F.col("p")
    df = spark.createDataFrame([(text,)], "t string").select(read_time(F.col("t"), F.lit(order)).alias("p"))
    assert df.select(to_second(F.coalesce(p["instant_us"], to_instant(p["wall_us"], F.coalesce(p["zone"], F.lit(zone)))))).first()[0] == out


@pytest.mark.parametrize(
    "text, order, out",
    [
        ("24640", "DMY", "1967-06-17"), ("19920821", "DMY", "1992-08-21"), ("03/02/90", "DMY", "1990-02-03"), ("11/03/77", "MDY", "1977-11-03"), ("07-12-02", "DMY", "2002-12-07"),
        ("1982-05-22T00:00:00-05:00", "DMY", "1982-05-22"), ("1951 оны 8 сарын 23", "YMD", "1951-08-23"), ("28 Nov 1974", "DMY", "1974-11-28"), ("31.02.1981", "DMY", None), ("0000-00-00", "YMD", None),
        ("nil", "YMD", None), (None, "DMY", None), ("1899-01-01", "YMD", None),
    ],
)
def test_births(spark, text, order, out):
    df = spark.createDataFrame([(text,)], "t string").select(F.date_from_unix_date(read_birth(F.col("t"), F.lit(order))).cast("string"))
    assert df.first()[0] == out


def test_missing_zone_is_estimated(spark):
    """A source without a listed zone: its local times lie near instants of the other column only in New York."""
    systems = spark.createDataFrame(SYSTEMS, "code string, zone string, dateorder string")
    rows = [("t", k, f"2024-0{1 + k % 6}-15 0{k % 9}:10:00", "lost", f"2024-0{1 + k % 6}-15T{k % 9 + (5 if 1 + k % 6 <= 2 else 4):02d}:25:00Z", "ub", "clash") for k in range(12)]
    times = spark.createDataFrame(rows, "fieldname string, recordid long, text string, source string, other_text string, other_source string, zone string").drop("zone")
    got = {r["recordid"]: r["normalised"] for r in normalise_times.normalise_times(times, systems).collect()}
    assert got[0] == "2024-01-15T05:10:00Z" and got[5] == "2024-06-15T09:10:00Z" and len(got) == 12
    assert normalise_times.normalise_times(times.limit(0), systems).count() == 0


@pytest.mark.parametrize(
    "line, fields, ok",
    [('a;"b;c";d', ["a", "b;c", "d"], True), ('"a ""q"" b";', ['a "q" b', ""], True), ('"open;x', ["open;x"], False), ('"a"x;b', ["a"], False), ('a"b;c', ['a"b', "c"], True), ("", [""], True), ('"";x', ["", "x"], True)],
)
def test_split_line(line, fields, ok):
    assert delimited.split_line(line, ";") == (fields, ok)


def test_split_line_round_trip():
    rng = random.Random(3)
    for _ in range(500):
        row = ["".join(rng.choice('a";, х') for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 6))]
        line = ";".join('"' + f.replace('"', '""') + '"' for f in row)
        assert delimited.split_line(line, ";") == (row, True)


@pytest.mark.parametrize(
    "values, kind",
    [
        (["1.50", "₮2,000.00", "-3.1", "abc"], "fraction"), (["12", "7", ""], "whole"), (["2024-01-02", "2023-05-06"], "date"), (["02.01.2024 10:00:00"], "datetime"),
        (["1653482878", "1649472271"], "epoch"), (["Y", "N", "Y"], "flag"), (["R8", "OUT"], "text"), (["", " "], ""), (["2 984 112", "12 000"], "whole"),
    ],
)
def test_column_type(values, kind):
    assert delimited.column_type(values) == kind


PROFILES = [("P", "BANK", ["Огноо", "Amount"], {"date": ["Огноо", "posting_day"], "amount": ["Amount", "Дүн"], "description": ["memo"]})]


def _tables(spark, files):
    p = spark.createDataFrame(PROFILES, "profileId string, domain string, requiredHeaders array<string>, fieldMap map<string,array<string>>")
    f = spark.createDataFrame([(i, feed, seq, c, "P", "x") for i, feed, seq, c in files], "fileId long, feedId string, seqNo long, content string, profileId string, reason string")
    return f, p


def test_failures_and_their_reasons(spark):
    body = "﻿Хуулга\n\nposting_day;x_Amount;memo\n2024-01-01;1,000.50;a\n2024-02-30;5;b\n2024-01-02;1O0;c\n2024-01-03;;d\n;1;e\n2024-01-04;2\n\"2024-01-05;3;f\n\"2024-01-05\"x;3;f\nposting_day;x_Amount;memo\n\n2024-01-06;-₮4;\"g;h\"\n"
    files, profiles = _tables(spark, [(1, "f", 1, body), (2, "f", 2, None), (3, "f", 3, ""), (4, "f", 4, "one line only")])
    got = parse_failures.parse_files(files, profiles)
    assert {(r["lineno"], r["reason"]) for r in got.where("reason is not null").collect()} == {(5, "value"), (6, "value"), (8, "value"), (9, "column_count"), (10, "quoting"), (11, "quoting")}
    assert [r["lineno"] for r in got.where("reason is null").orderBy("lineno").collect()] == [4, 7, 14]
    assert parse_failures.parse_files(files.limit(0), profiles).count() == 0


def test_schema_changes(spark):
    one = "Огноо;Amount;memo\n" + "".join(f"2024-01-{d:02d};{d}.50;чөлөөт бичвэр {d}\n" for d in range(1, 10))
    two = "memo;posting_day; amount \n" + "".join(f"чөлөөт бичвэр {d};2024-01-{d:02d};{d}.75\n" for d in range(1, 10))
    three = "memo;posting_day;Amount;till_id\n" + "".join(f"чөлөөт бичвэр {d};17040672{d:02d};{d};44{d}\n" for d in range(10, 20))
    four = "new memo;posting_day;till_id\n" + "".join(f"чөлөөт бичвэр {d};17040672{d:02d};44{d}\n" for d in range(10, 20))
    files, profiles = _tables(spark, [(1, "f", 1, one), (2, "f", 2, two), (3, "f", 3, three), (4, "f", 4, four), (5, "g", 1, four), (6, None, 1, one)])
    got = {tuple(r) for r in schema_drift.schema_changes(files, profiles).collect()}
    assert got == {
        (2, "renamed", "огноо", "posting_day"), (3, "added", "", "till_id"), (3, "retyped", "posting_day", "posting_day"), (3, "retyped", "amount", "amount"),
        (4, "removed", "amount", ""), (4, "renamed", "memo", "new memo"),
    }
    rows = schema_drift.unified(files, profiles)
    assert rows.where("fileid = 2 and lineno = 2").first()["data"] == {"description": "чөлөөт бичвэр 1", "date": "2024-01-01", "amount": "1.75"}
    assert schema_drift.schema_changes(files.limit(0), profiles).count() == 0


def test_renames_are_carried_into_the_unified_table(spark):
    """A known field and an unknown column renamed to unknown headers, a column known only later, a header used anew."""
    def text(names, last=""):
        return ";".join(names) + last + "\n" + "".join(f"2024-01-{d:02d};чөлөөт бичвэр {d};зүйл ангилал {d};{d}" + (f";{d}.5" if last else "") + "\n" for d in range(1, 10))

    files, profiles = _tables(spark, [
        (1, "f", 1, text(["Огноо", "memo", "тэмдэглэгээ", "till"])), (2, "f", 2, text(["Огноо", "ghjkq", "тэмдеглэгээ", "tills"])), (3, "f", 3, text(["Огноо", "vwzxp", "тэмдеглэгэ", "tillss"])),
        (4, "f", 4, text(["Огноо", "vwzxp", "тэмдеглэгэ", "tillss"], ";till")), (5, "g", 1, text(["Огноо", "qqqq", "x1", "n1"])), (6, "g", 2, text(["Огноо", "memo", "x1", "n1"])), (7, None, 1, text(["Огноо", "ghjkq", "x1", "n1"])),
    ])
    got = {r["fileid"]: r["data"] for r in schema_drift.unified(files, profiles).where("data['date'] = '2024-01-01'").collect()}
    row = {"date": "2024-01-01", "description": "чөлөөт бичвэр 1", "тэмдэглэгээ": "зүйл ангилал 1", "till": "1"}
    assert got[1] == got[2] == got[3] == row
    assert got[4] == row | {"till 2": "1.5"}
    assert got[5] == got[6] and got[5]["description"] == "чөлөөт бичвэр 1"
    assert got[7]["ghjkq"] == "чөлөөт бичвэр 1"


def test_nested_schemas():
    n = schema_drift.Node
    a = n("", children=[n("id", kind="whole"), n("who", children=[n("name", kind="text", words=["x"]), n("born", kind="date")])])
    b = n("", children=[n("who", children=[n("name", kind="text", words=["x"]), n("born", kind="datetime"), n("sex", kind="flag")]), n("id", kind="whole")])
    assert schema_drift.tree_edit(a, b)[1] == [("retyped", "born", "born"), ("added", "", "sex")]


def test_a_subtree_under_another_parent_is_moved():
    n = schema_drift.Node
    a = n("", children=[n("who", children=[n("name", kind="text"), n("address", children=[n("city", kind="text"), n("no", kind="whole")])]), n("job", children=[n("title", kind="text")])])
    b = n("", children=[n("who", children=[n("name", kind="text")]), n("job", children=[n("title", kind="text"), n("address", children=[n("city", kind="text"), n("no", kind="fraction")])])])
    cost, script = schema_drift.tree_edit(a, b)
    assert script == [("moved", "who.address", "job.address"), ("retyped", "no", "no")] and cost == pytest.approx(schema_drift.MOVE + schema_drift.RETYPE)


def test_assignment_is_the_best_of_all():
    rng = random.Random(1)
    for _ in range(300):
        r, c = rng.randint(1, 4), rng.randint(1, 4)
        gain = {(i, j): rng.random() for i in range(r) for j in range(c) if rng.random() < 0.6}
        got = schema_drift.best_assignment(gain, r, c)
        best = max(sum(gain.get((i, p[i]), 0) for i in range(max(r, c))) for p in itertools.permutations(range(max(r, c))))
        assert sum(gain[e] for e in got.items()) == pytest.approx(best)
    # greedy would take a-c and leave b and d
    assert schema_drift.best_assignment({(0, 0): 1.0, (0, 1): 0.9, (1, 0): 0.9}, 2, 2) == {0: 1, 1: 0}


def test_typed_values_of_retyped_columns(spark):
    rows = [(1, {"date": "2024-03-01 10:00:00", "amount": "1,250.50"}), (2, {"date": "1709287200", "amount": "₮ 7"}), (3, {"date": "1709287200000"}), (4, {"date": None, "amount": None}), (5, None)]
    got = schema_drift.typed(spark.createDataFrame(rows, "id long, data map<string,string>")).orderBy("id").collect()
    assert [r["at_us"] for r in got] == [1709287200000000] * 3 + [None] * 2
    assert [r["amounts"] for r in got] == [{"amount": 1250.5}, {"amount": 7.0}, {}, {}, None]


def test_estimated_zones_tell_a_quarter_of_an_hour_apart(spark):
    """Two listed sources show how far aligned times lie apart; Kolkata is not Kathmandu; a listed null zone is estimated too."""
    rng = random.Random(4)
    systems = spark.createDataFrame([("utc", "UTC", "YMD"), ("ub", "Asia/Ulaanbaatar", "YMD"), ("in", None, None)], "code string, zone string, dateorder string")
    at = lambda us: dt.datetime.fromtimestamp(us, dt.timezone.utc)
    rows = []
    for k in range(400):
        t = 1_700_000_000 + rng.randrange(300 * 86400)
        u = t + rng.randrange(-1800, 1801)
        other = f"{at(u):%Y-%m-%d %H:%M:%S}"
        if k % 2:
            rows.append(("t", k, f"{at(t + 8 * 3600):%Y-%m-%d %H:%M:%S}", "ub", other, "utc"))
        else:
            rows.append(("t", k, f"{at(t + 19_800):%d/%m/%Y %H:%M:%S}", "in", other, "utc"))
    times = spark.createDataFrame(rows, "fieldname string, recordid long, text string, source string, other_text string, other_source string")
    z = normalise_times.estimate_zones(normalise_times._aligned(times, systems.withColumnRenamed("code", "source")), systems).collect()
    assert [(r["source"], r["dateorder"]) for r in z] == [("in", "DMY")] and z[0]["zone"] in ("Asia/Calcutta", "Asia/Colombo", "Asia/Kolkata")
    assert normalise_times.normalise_times(times, systems).count() == 400
