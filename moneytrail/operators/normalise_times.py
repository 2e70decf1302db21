"""Problem 3: mixed timestamp formats and time zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moneytrail.functions.times import DAY_US, read_birth, read_time, to_instant, to_second
from moneytrail.plans.session import table

TOGETHER_S = 7200  # two aligned times of one record lie within so many seconds


MINUTE_US = 60_000_000
TYPICAL = 0.999  # share of aligned times of known zones that lie within the distance taken as allowed


def zone_names(spark: SparkSession) -> list[str]:
    """The regions of the zone database and UTC, about 430 (research stations left out): names whose histories of offsets tell them apart."""
    ids = spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds()
    regions = ("Africa/", "America/", "Asia/", "Atlantic/", "Australia/", "Europe/", "Indian/", "Pacific/")
    return sorted(z for z in ids if z.startswith(regions)) + ["UTC"]


def estimate_zones(readings: DataFrame, systems: DataFrame) -> DataFrame:
    """(source, zone, dateorder) of sources for which systems lists no zone.

    readings: (source, text, other_us, apart_us): local times with the instant they are aligned
    with (another time of the record, or its ingestion) and, where their zone is known, the
    distance to it, from which the allowed distance is learnt (at most TOGETHER_S).  Each text is read once per date order; all
    readings of a source are counted by day and implied offset, and only these counts meet the
    zones of the zone database.  The offset history with the fewest violations (readings farther
    than allowed from their partner) wins, then the least total distance, then zones that
    systems lists, then the name.
    """
    listed = systems.where("zone is not null")
    missing = readings.join(F.broadcast(listed.select(F.col("code").alias("source"))), "source", "left_anti").where("source is not null and other_us is not null")  # one row per source system
    orders = F.explode(F.array(*(F.lit(o) for o in ("YMD", "DMY", "MDY"))))
    r = missing.withColumn("dateorder", orders).withColumn("p", read_time(F.col("text"), F.col("dateorder")))
    offset = F.round((F.col("p.wall_us") - F.col("other_us")) / MINUTE_US).cast("long")
    bins = r.groupBy("source", "dateorder", F.floor(F.col("p.wall_us") / DAY_US).alias("day"), offset.alias("minutes"), F.col("p.zone").isNull().alias("local")).agg(F.count("*").alias("n"))
    bins = bins.where("local or day is null")
    spark = readings.sparkSession
    zones = spark.createDataFrame([(z,) for z in zone_names(spark)], "zone string").join(F.broadcast(listed.select("zone").distinct().withColumn("known", F.lit(0))), "zone", "left")
    noon = F.col("day") * DAY_US + DAY_US // 2
    allowed = readings.agg(F.least(F.lit(TOGETHER_S / 60), F.coalesce(F.percentile_approx(F.abs("apart_us"), TYPICAL, 10_000) / MINUTE_US + 1, F.lit(TOGETHER_S / 60))).alias("allowed"))
    scored = bins.join(F.broadcast(zones)).join(F.broadcast(allowed))  # about 430 rows, one row; bins are counts
    shift = F.abs(F.col("minutes") - (noon - to_instant(noon, F.col("zone"))) / MINUTE_US)
    # a text that no date order reads, or a time beyond a day from its partner, counts against the order
    far = F.coalesce(shift, F.lit(1440.0))
    g = scored.groupBy("source", "zone", "dateorder", "known").agg(
        F.sum(F.when(far > F.col("allowed"), F.col("n")).otherwise(0)).alias("violations"), F.sum(F.least(far, F.lit(1440.0)) * F.col("n")).alias("distance"), F.count("day").alias("read")
    )
    rank = F.struct("violations", "distance", F.coalesce("known", F.lit(1)), "zone", "dateorder")
    best = g.where("read > 0").groupBy("source").agg(F.min_by(F.struct("zone", "dateorder"), rank).alias("b"))
    return best.select("source", "b.zone", "b.dateorder")


def _aligned(times: DataFrame, known: DataFrame) -> DataFrame:
    """(source, text, other_us, apart_us) of times, see estimate_zones."""
    other = known.select(*(F.col(c).alias(f"other_{c}") for c in known.columns))
    p = F.col("p")
    paired = times.join(F.broadcast(other), "other_source", "left").withColumn("p", read_time(F.col("other_text"), F.col("other_dateorder")))
    other_us = F.coalesce(p["instant_us"], to_instant(p["wall_us"], F.coalesce(p["zone"], "other_zone")))
    own = paired.join(F.broadcast(known.select("source", F.col("zone").alias("own_zone"), F.col("dateorder").alias("own_order"))), "source", "left").withColumn("q", read_time(F.col("text"), F.col("own_order")))
    own_us = to_instant(F.col("q.wall_us"), F.coalesce("q.zone", "own_zone"))
    return own.select("source", "text", other_us.alias("other_us"), (own_us - other_us).alias("apart_us"))


def normalise_times(times: DataFrame, systems: DataFrame) -> DataFrame:
    """(fieldname, recordid, normalised) of times (fieldname, recordid, text, source, other_text,
    other_source) that denote an instant.

    A zone in the text wins over that of the source; the zone of an unlisted source is
    estimated.  Null, blank and impossible texts, and local times without any zone, have no
    row; extra columns are ignored.
    """
    known = systems.select(F.col("code").alias("source"), "zone", "dateorder")
    listed = F.broadcast(known.where("zone is not null").select("source"))  # one row per source system
    if times.where("source is not null").select("source").distinct().join(listed, "source", "left_anti").isEmpty():
        guessed = known.limit(0)
    else:
        guessed = estimate_zones(_aligned(times, known), systems)
    stated = known.where("zone is not null").unionByName(known.where("zone is null").join(guessed, "source", "left_anti"))
    zones = stated.unionByName(guessed)
    t = times.join(F.broadcast(zones), "source", "left").withColumn("p", read_time(F.col("text"), F.col("dateorder")))  # one row per source system
    p = F.col("p")
    us = F.coalesce(p["instant_us"], to_instant(p["wall_us"], F.coalesce(p["zone"], "zone")))
    return t.select("fieldname", "recordid", to_second(us).alias("normalised")).where("normalised is not null")


def normalise_births(births: DataFrame, systems: DataFrame) -> DataFrame:
    """(recordid, normalised) of births (recordid, text, source) that are existing dates."""
    orders = F.broadcast(systems.select(F.col("code").alias("source"), "dateorder"))
    days = read_birth(F.col("text"), F.col("dateorder"))
    return births.join(orders, "source", "left").select("recordid", F.date_from_unix_date(days).cast("string").alias("normalised")).where("normalised is not null")


def _hit_times(hits: DataFrame) -> DataFrame:
    """Both times of each hit, each with the other as its partner."""
    pair = ("transaction", "call")
    parts = [
        hits.select(
            F.lit(f"{me}Time").alias("fieldname"), F.col("id").alias("recordid"), F.col(f"{me}Time").alias("text"), F.col(f"{me}Source").alias("source"),
            F.col(f"{you}Time").alias("other_text"), F.col(f"{you}Source").alias("other_source"),
        )
        for me, you in (pair, pair[::-1])
    ]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, systems = table(spark, sf_dir, "correlation_hits"), table(spark, sf_dir, "source_systems")
    births = table(spark, sf_dir, "suspects").select(F.col("id").alias("recordid"), F.col("dateOfBirth").alias("text"), F.col("dobSource").alias("source"))
    found = normalise_births(births, systems).select(F.lit("dateOfBirth").alias("fieldname"), "recordid", "normalised")
    return normalise_times(_hit_times(hits), systems).unionByName(found)


WITHHELD = ["chi_switch", "delhi_tel", "hovd_branch", "syd_cloud"]


def p3_estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times again, with the zones and date orders of four source systems withheld: they are estimated
    from the times that the other systems give the same records."""
    hits, systems = table(spark, sf_dir, "correlation_hits"), table(spark, sf_dir, "source_systems")
    return normalise_times(_hit_times(hits), systems.where(~F.col("code").isin(WITHHELD)))
