"""Times and dates written in many ways, as Column expressions (no Python on the data path).

A written time is read into a wall clock (microseconds since 1970 as if in UTC), or into an
instant where the text states one (epoch number, offset, zone abbreviation); a zone name in
the text or of the source turns a wall clock into an instant.  All arithmetic is on integers,
so the session time zone plays no part.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hours east of UTC of the zone abbreviations in use.
ABBREVIATIONS_TEXT = """
Z 0 UTC 0 GMT 0 BST 1 CET 1 CEST 2 EET 2 EEST 3 MSK 3 IST 5.5 HOVT 7 ULAT 8 KST 9 JST 9
AEST 10 AEDT 11 EST -5 EDT -4 CST -6 CDT -5 MST -7 MDT -6 PST -8 PDT -7
"""
_AB = ABBREVIATIONS_TEXT.split()
ABBREVIATIONS = {k.lower(): float(v) for k, v in zip(_AB[::2], _AB[1::2])}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DAY_US = 86_400_000_000

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([ap]m)?"


def _int(c: Column) -> Column:
    return c.try_cast("int")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: repeated text expressions would be evaluated again
    wherever they stand."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(text: Column) -> Column:
    """Trimmed lower-case text with plain blanks."""
    return F.lower(F.trim(F.regexp_replace(text, r"[\s\u00a0\u202f]+", " ")))


def written_date(date_text: Column, order: Column, births: bool = False) -> Column:
    """Days since 1970 of a cleaned date text.  order (YMD, DMY, MDY) holds for numeric dates
    that don't start with a four-digit year; a null order means DMY unless only MDY exists.
    Two-digit years lie in 2000-2099, of births in 1908-2007."""
    sep = r"[-/.]"
    iso, solid = rf"^(\d{{4}}){sep}(\d{{1,2}}){sep}(\d{{1,2}})$", r"^(\d{4})(\d{2})(\d{2})$"
    long_, short = rf"^(\d{{1,2}}){sep}(\d{{1,2}}){sep}(\d{{4}})$", rf"^(\d{{2}}){sep}(\d{{1,2}}){sep}(\d{{2}})$"
    local = r"^(\d{4}) оны (\d{1,2}) (?:дугаар |дүгээр )?сарын (\d{1,2})(?:-?ны|-?ний)?(?: өдөр)?$"
    dmy_text, mdy_text = r"^(\d{1,2})\.? ([a-z]{3})[a-z]*\.?,? (\d{4})$", r"^([a-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})$"

    def exists(t: Column, pattern: str, shape: str) -> Column:
        return F.regexp_replace(t, pattern, shape).try_cast("date")

    def century(t: Column, group: int) -> Column:
        yy = _int(F.regexp_extract(t, short, group))
        return F.when((yy <= 7) if births else F.lit(True), "20").otherwise("19")

    def by_order(dmy: Column, mdy: Column, ymd: Column) -> Column:
        return F.when(order == "DMY", dmy).when(order == "MDY", mdy).when(order == "YMD", ymd).otherwise(F.coalesce(dmy, mdy))

    def english(t: Column, pattern: str, shape: str) -> Column:
        return F.try_to_timestamp(F.regexp_replace(t, pattern, shape), F.lit("d MMM yyyy")).cast("date")

    def read(t: Column) -> Column:
        dmy4, mdy4 = exists(t, long_, "$3-$2-$1"), exists(t, long_, "$3-$1-$2")
        two = lambda shape, g: F.concat(century(t, g), F.regexp_replace(t, short, shape)).try_cast("date")
        return F.unix_date(
            F.when(t.rlike(iso), exists(t, iso, "$1-$2-$3"))
            .when(t.rlike(solid), exists(t, solid, "$1-$2-$3"))
            .when(t.rlike(long_), by_order(dmy4, mdy4, F.coalesce(dmy4, mdy4)))
            .when(t.rlike(short), by_order(two("$3-$2-$1", 3), two("$3-$1-$2", 3), two("$1-$2-$3", 1)))
            .when(t.rlike(local), exists(t, local, "$1-$2-$3"))
            .when(t.rlike(dmy_text), english(t, dmy_text, "$1 $2 $3"))
            .when(t.rlike(mdy_text), english(t, mdy_text, "$2 $1 $3"))
        )

    return let(date_text, read)


def _date_part(t: Column) -> Column:
    """The text before the clock, without weekday, comma and T."""
    head = F.regexp_replace(t, r"[t ,]*" + _CLOCK + r".*$", "")
    return F.trim(F.regexp_replace(head, r"^[a-z]{2,9}, ", ""))


def _clock_us(t: Column) -> Column:
    """Microseconds since midnight, null if there is no valid clock."""

    def read(g: Column) -> Column:
        h, m, s = (_int(g[k]) for k in (1, 2, 3))
        ap = g[5]
        hour = F.when(ap == "", h).when(h.between(1, 12), h % 12 + F.when(ap == "pm", 12).otherwise(0))
        sec = F.when(g[3] == "", 0).otherwise(s)
        ok = hour.between(0, 23) & m.between(0, 59) & sec.between(0, 59)
        return F.when(ok, (hour.cast("long") * 3600 + m * 60 + sec) * 1_000_000 + _int(F.substring(F.rpad(g[4], 6, "0"), 1, 6)))

    groups = F.array(*[F.regexp_extract(t, _CLOCK, k) for k in range(6)])
    return let(groups, lambda g: F.when(g[0] != "", read(g)))


def read_time(text: Column, order: Column) -> Column:
    """struct(instant_us, wall_us, zone) of a written time; nulls where it denotes none.

    instant_us is set where the text fixes the instant; zone is a zone name in the text."""
    solid = r"^(\d{8})t?(\d{2})(\d{2})(\d{2})(.*)$"
    names = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, int(v * 60))])
    kind = "struct<instant_us:bigint,wall_us:bigint,zone:string>"

    def result(instant=None, wall=None, zone=None) -> Column:
        null = F.lit(None)
        return F.struct(*[(c if c is not None else null).cast(k).alias(n) for c, k, n in ((instant, "long", "instant_us"), (wall, "long", "wall_us"), (zone, "string", "zone"))])

    def offset_of(tail: Column) -> Column:
        shape = r"^([+-]\d{2}):?(\d{2})?$"
        hours = F.regexp_extract(tail, shape, 1)
        minutes = F.coalesce(_int(F.regexp_extract(tail, shape, 2)), F.lit(0))
        numeric = _int(hours) * 60 + F.when(hours.startswith("-"), -minutes).otherwise(minutes)
        return F.when(tail.rlike(shape), numeric).otherwise(F.try_element_at(names, tail))

    def clocked(spread: Column) -> Column:
        wall = written_date(_date_part(spread), order).cast("long") * DAY_US + _clock_us(spread)
        tail = F.trim(F.regexp_replace(spread, r"^.*?" + _CLOCK, ""))
        zone = F.regexp_extract(F.trim(text), r"\[([A-Za-z0-9_+/-]+)\]$", 1)
        parts = F.struct(wall.alias("wall"), tail.alias("tail"), offset_of(tail).alias("offset"), zone.alias("zone"))
        return let(
            parts,
            lambda p: F.when(p["offset"].isNotNull(), result(instant=p["wall"] - p["offset"].cast("long") * 60_000_000))
            .when(p["zone"] != "", result(wall=p["wall"], zone=p["zone"]))
            .when(p["tail"] == "", result(wall=p["wall"]))
            .otherwise(result()),
        )

    def read(t: Column) -> Column:
        return (
            F.when(t.rlike(r"^\d{10}$"), result(instant=t.try_cast("long") * 1_000_000))
            .when(t.rlike(r"^\d{13}$"), result(instant=t.try_cast("long") * 1000))
            .when(t.rlike(r"^\d{5}(\.\d+)?$"), result(wall=F.round((t.try_cast("decimal(20,10)") - 25569) * 86400).cast("long") * 1_000_000))
            .otherwise(let(F.when(t.rlike(r"^\d{8}(t\d{6}|\d{6}$)"), F.regexp_replace(t, solid, "$1 $2:$3:$4$5")).otherwise(t), clocked))
        ).cast(kind)

    return let(clean(text), read)


def to_instant(wall_us: Column, zone: Column) -> Column:
    """The instant of a wall clock in a named zone: of two the earlier, a skipped one by the offset before."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall_us), zone))


def to_second(us: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ssZ of the nearest second."""
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")

    def write(s: Column) -> Column:
        day, rest = F.floor(s / 86400).cast("int"), F.pmod(s, F.lit(86400))
        clock = F.concat_ws(":", two(rest / 3600), two((rest / 60) % 60), two(rest % 60))
        return F.when(s.isNotNull(), F.concat(F.date_from_unix_date(day).cast("string"), F.lit("T"), clock, F.lit("Z")))

    return let(F.floor((us + 500_000) / 1_000_000).cast("long"), write)


def read_birth(text: Column, order: Column, first: int = 1940, last: int = 2007) -> Column:
    """Days since 1970 of a written date of birth, its clock and offset ignored; a number of five
    digits counts days of a spreadsheet.  Null outside the years first to last."""

    def read(t: Column) -> Column:
        serial = F.floor(t.try_cast("decimal(20,10)")).cast("int") - 25569
        spread = F.when(t.rlike(r"^\d{8}t?\d{6}"), F.substring(t, 1, 8)).otherwise(t)
        return F.when(t.rlike(r"^\d{5}(\.\d+)?$"), serial).otherwise(written_date(_date_part(spread), order, births=True))

    inside = lambda days: F.when(F.year(F.date_from_unix_date(days)).between(first, last), days)
    return let(let(clean(text), read), inside)
