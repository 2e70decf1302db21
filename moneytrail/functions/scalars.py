"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moneytrail.functions.times import DAY_US, clean, read_time


def clean_amount(c: Column) -> Column:
    """A typed amount as double: the later of the last "." and "," is the decimal mark if one or two
    characters follow it, all other separators go; null, empty and digitless text is 0."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9,.+\-]", "")
    mark = F.regexp_extract(t, r"^(.*)[.,](.{1,2})$", 0) != ""
    whole, cents = F.regexp_extract(t, r"^(.*)[.,](.{1,2})$", 1), F.regexp_extract(t, r"^(.*)[.,](.{1,2})$", 2)
    plain = F.when(mark, F.concat(F.regexp_replace(whole, "[.,]", ""), F.lit("."), cents)).otherwise(F.regexp_replace(t, "[.,]", ""))
    return F.coalesce(F.regexp_extract(plain, r"^[+-]?\d*\.?\d+", 0).try_cast("double"), F.lit(0.0))


def read_datetime(c: Column) -> Column:
    """Microseconds of a date with or without a clock, or a spreadsheet serial from 1 to 100000; null if neither.
    Times without a zone count as UTC."""
    t = clean(c)
    n = t.try_cast("double")
    r = read_time(F.when(t.rlike(r"\d:\d"), t).otherwise(F.concat(t, F.lit(" 00:00"))), F.lit("DMY"))
    serial = F.round((n - 25569) * 86400).cast("long") * 1_000_000
    return F.when(n.isNotNull() & n.between(1, 100000), serial).otherwise(F.coalesce(r["instant_us"], r["wall_us"]))


def apply_time_of_day(us: Column, clock: Column) -> Column:
    """The instant with a clock column's time (HH:MM[:SS] [am|pm] or a day fraction), if its own time is midnight."""
    t = clean(clock)
    p = r"^(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([ap]m)?$"
    h, m, s, ap = F.regexp_extract(t, p, 1).try_cast("int"), F.regexp_extract(t, p, 2).try_cast("int"), F.regexp_extract(t, p, 3).try_cast("int"), F.regexp_extract(t, p, 4)
    h = F.when((ap == "pm") & (h < 12), h + 12).when((ap == "am") & (h == 12), 0).otherwise(h)
    sec = F.when(t.rlike(p) & (h < 24) & (m < 60), h * 3600 + m * 60 + F.coalesce(s, F.lit(0)))
    frac = t.try_cast("double")
    sec = F.coalesce(sec, F.when((frac >= 0) & (frac < 1), F.round(frac * 86400).cast("int")))
    return F.when((us % DAY_US == 0) & sec.isNotNull(), us + sec.cast("long") * 1_000_000).otherwise(us)


def unwrap_caller(c: Column) -> Column:
    """The number in "name <number>", else the text; digits and + only."""
    inner = F.regexp_extract(c, r"<([^>]+)>", 1)
    return F.regexp_replace(F.when(inner != "", inner).otherwise(c), r"[^0-9+]", "")


def money(c: Column, symbol: str = "₮", decimals: int = 0) -> Column:
    """Symbol and grouped number, halves away from zero."""
    return F.concat(F.lit(f"{symbol} "), F.format_number(F.round(c.cast("decimal(28,6)"), decimals), decimals))


def screen_normal(c: Column) -> Column:
    return F.translate(F.lower(F.trim(F.regexp_replace(c, r"[\x00-\x1F]", ""))), "ё", "е")


def canonical_enum(c: Column, members: list[str]) -> Column:
    """Upper snake case of a Pascal or lower-case value; the raw value without regard to case; else the first member."""
    snake = F.upper(F.regexp_replace(F.trim(c), r"(?<=[^A-Z])([A-Z])", "_$1"))
    raw = F.upper(F.trim(c))
    return F.when(snake.isin(members), snake).when(raw.isin(members), raw).otherwise(F.lit(members[0]))


def minutes_between(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 6e7


def json_ids(c: Column) -> Column:
    """A JSON array of ids, [] if it can't be read."""
    return F.coalesce(F.from_json(c, "array<bigint>"), F.array().cast("array<bigint>"))
