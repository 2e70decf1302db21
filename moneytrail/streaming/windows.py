"""Detectors on streams: daily windows and duplicate suppression with watermarks.  Batch frames give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneytrail.config import MNT, AmlConfig


def daily_flows(txns: DataFrame, cfg: AmlConfig = MNT, late: str = "1 day") -> DataFrame:
    """Per account and day (acct, ts, type, amount): inflow and outflow, and whether the money only passed through."""
    day = F.window(F.col("ts").cast("timestamp"), "1 day")
    credit = F.col("type") == "credit"
    t = txns.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = t.groupBy(day.alias("w"), "acct").agg(F.sum(F.when(credit, F.col("amount"))).alias("inflow"), F.sum(F.when(~credit, F.col("amount"))).alias("outflow"), F.count("*").alias("n"))
    mule = F.coalesce((F.col("inflow") > cfg.mule_inflow) & (F.col("outflow").cast("double") > F.col("inflow").cast("double") * cfg.mule_ratio), F.lit(False))
    return g.select("acct", F.to_date("w.start").alias("day"), F.col("inflow").cast("double").alias("inflow"), F.col("outflow").cast("double").alias("outflow"), "n", mule.alias("mule"))


def first_accesses(access: DataFrame, late: str = "1 day") -> DataFrame:
    """Access rows (ts, user, ip) once each while they are within the watermark."""
    a = access.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return a.dropDuplicatesWithinWatermark(["ts", "user", "ip"]) if a.isStreaming else a.dropDuplicates(["ts", "user", "ip"])
