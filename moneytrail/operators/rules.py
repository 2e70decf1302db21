"""The rule engine: violations, scores, features, pattern alerts.

Every rule is one partitioned pass over all accounts; ties in time are broken by id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.config import MNT, AmlConfig
from moneytrail.operators.ledger import is_credit, micros, near_threshold, off_hours, round_number, stamp, total

def by_account():
    return Window.partitionBy("acct").orderBy("ts", "id")


def _row(df: DataFrame, rule: int, severity: str, score: float, what, when) -> DataFrame:
    return df.select("acct", F.lit(rule).cast("long").alias("rule"), F.lit(severity).alias("severity"), F.lit(score).alias("score"), what.cast("string").alias("what"), when.alias("at"))


def _first(df: DataFrame, order: list, k: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy("acct").orderBy(*order))).where(F.col("_k") <= k)


def velocity(l: DataFrame, cfg: AmlConfig = MNT) -> DataFrame:
    """Six transactions (five at the end of the list) within ten minutes; the first such slice."""
    end = F.coalesce(F.lead("ts", 5).over(by_account()), F.lead("ts", 4).over(by_account()))
    n = F.when(F.lead("ts", 5).over(by_account()).isNotNull(), 6).otherwise(5)
    hits = l.withColumn("end", end).withColumn("k", n).where("end is not null").where((micros("end") - micros("ts")) / 6e7 < cfg.velocity_minutes)
    return _row(_first(hits, ["ts", "id"], 1), 1, "HIGH", 0.30, F.col("k"), stamp("ts"))


def anomaly(l: DataFrame) -> DataFrame:
    """|z| above 3 against the account's own mean and sample deviation; the first five in time."""
    stats = l.groupBy("acct").agg(F.avg("amt").alias("mean"), F.stddev_samp("amt").alias("sd")).where("sd > 0")
    z = l.join(stats, "acct").where((F.col("amt") - F.col("mean")) / F.col("sd") > 3)
    return _row(_first(z, ["ts", "id"], 5), 2, "HIGH", 0.20, F.col("id"), stamp("ts"))


def structuring_clusters(l: DataFrame, cfg: AmlConfig = MNT) -> DataFrame:
    """Per counterparty and ISO week: three or more amounts below the threshold that reach it together."""
    g = l.where("cp is not null and cp <> ''").groupBy("acct", "cp", F.expr("extract(yearofweek from ts)").alias("y"), F.weekofyear("ts").alias("w"))
    g = g.agg(F.count("*").alias("n"), F.max("amount").alias("top"), F.sum("amount").alias("s"), F.min("ts").alias("first_ts"), F.min(F.struct("ts", "id")).alias("o"))
    return _first(g.where((F.col("n") >= 3) & (F.col("top") < cfg.reporting) & (F.col("s") >= cfg.reporting)), ["o"], 5)


def structuring(l: DataFrame, cfg: AmlConfig = MNT) -> DataFrame:
    return _row(structuring_clusters(l, cfg), 3, "CRITICAL", 0.40, F.col("cp"), stamp("first_ts"))


def approaching(l: DataFrame, cfg: AmlConfig = MNT) -> DataFrame:
    """Amounts just below the threshold, unless the counterparty is in a structuring cluster already."""
    known = structuring_clusters(l, cfg).select("acct", "cp").distinct()
    near = l.where(near_threshold(cfg)).where("cp is not null and cp <> ''").join(known, ["acct", "cp"], "left_anti")
    return _row(_first(near, ["ts", "id"], 3), 4, "MEDIUM", 0.10, F.col("id"), stamp("ts"))


def round_amounts(l: DataFrame, cfg: AmlConfig = MNT) -> DataFrame:
    """Five or more round amounts among the last ten."""
    last = _first(l, [F.desc("ts"), F.desc("id")], 10)
    g = last.groupBy("acct").agg(F.count_if(round_number(cfg)).alias("n")).where("n >= 5")
    return _row(g, 5, "MEDIUM", 0.15, F.col("n"), F.lit(None).cast("string"))


def surge(l: DataFrame, cfg: AmlConfig = MNT) -> DataFrame:
    g = l.where("cp is not null and cp <> ''").groupBy("acct", F.to_date("ts").alias("d")).agg(F.count_distinct("cp").alias("n")).where(F.col("n") > cfg.surge_recipients)
    return _row(_first(g, ["d"], 3), 6, "HIGH", 0.25, F.col("n"), F.date_format("d", "yyyy-MM-dd HH:mm:ss"))


def night(l: DataFrame, cfg: AmlConfig = MNT) -> DataFrame:
    g = l.where(off_hours(cfg) & (F.col("amount") > cfg.high_value)).groupBy("acct").agg(F.count("*").alias("n"), F.min("ts").alias("t"))
    return _row(g, 7, "MEDIUM", 0.15, F.col("n"), stamp("t"))


def mule(l: DataFrame, cfg: AmlConfig = MNT) -> DataFrame:
    """The first day whose inflow is large and flows out again."""
    g = l.groupBy("acct", F.to_date("ts").alias("d")).agg(F.sum(F.when(is_credit(), F.col("amount"))).alias("c"), F.sum(F.when(~is_credit(), F.col("amount"))).alias("o"))
    g = g.where((F.col("c") > cfg.mule_inflow) & (F.col("o").cast("double") > F.col("c").cast("double") * cfg.mule_ratio))
    return _row(_first(g, ["d"], 1), 10, "CRITICAL", 0.40, F.col("c").cast("double").cast("long"), F.date_format("d", "yyyy-MM-dd HH:mm:ss"))


def smurf_days(l: DataFrame, cfg: AmlConfig = MNT) -> DataFrame:
    """Days with small credits from three or more sources that add up."""
    small = l.where(is_credit() & (F.col("amount") < cfg.smurf_unit))
    g = small.groupBy("acct", F.to_date("ts").alias("d")).agg(
        F.count_distinct(F.nullif("cp", F.lit(""))).alias("sources"), F.sum("amount").alias("s"), F.min("ts").alias("t0"), F.max("ts").alias("t1")
    )
    return g.where((F.col("sources") >= 3) & (F.col("s") > cfg.smurf_total))


def smurfing(l: DataFrame, cfg: AmlConfig = MNT) -> DataFrame:
    return _row(_first(smurf_days(l, cfg), ["d"], 1), 11, "CRITICAL", 0.35, F.col("sources"), stamp("t0"))


def round_trip(l: DataFrame) -> DataFrame:
    """One of the first 200 rows and one of the nine after it, of opposite type, within five percent."""
    # a row number with a bound is a top-k: each task keeps no more than 209 rows of an account before the shuffle
    n = l.select("acct", "type", "amt", "ts", "id").withColumn("rn", F.row_number().over(by_account())).where("rn <= 209")
    ahead = F.array(*[F.struct(F.lead("type", k).over(Window.partitionBy("acct").orderBy("rn")).alias("type"), F.lead("amt", k).over(Window.partitionBy("acct").orderBy("rn")).alias("amt"), F.lit(k).alias("k")) for k in range(1, 10)])
    hit = n.withColumn("next", ahead).where("rn <= 200").withColumn("k", F.expr("get(filter(next, x -> x.type is not null and (x.type = 'credit') <> (type = 'credit') and abs(x.amt - amt) < amt * 0.05), 0).k")).where("k is not null")
    return _row(_first(hit, ["rn", "k"], 1), 12, "HIGH", 0.20, F.col("id"), stamp("ts"))


RULES = {
    "rule_velocity": velocity, "rule_anomaly": anomaly, "rule_structuring": structuring, "rule_approaching": approaching, "rule_round_amounts": round_amounts,
    "rule_surge": surge, "rule_night": night, "rule_mule": mule, "rule_smurfing": smurfing, "rule_round_trip": round_trip,
}


def violations(l: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (f(l) for f in RULES.values()))


def rule_scores(l: DataFrame) -> DataFrame:
    """Sum of scores (exact decimals) to at most 1, a boost by severity, action and risk; accounts without a violation too."""
    v = violations(l).groupBy("acct").agg(
        F.sum(F.col("score").cast("decimal(4,2)")).alias("s"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "HIGH").alias("high"), F.count("*").alias("violations")
    )
    one = F.lit(1).cast("decimal(10,2)")
    a = l.select("acct").distinct().join(v, "acct", "left").na.fill(0, ["critical", "high", "violations"])
    base = F.least(one, F.coalesce(F.col("s"), F.lit(0)).cast("decimal(10,2)"))
    boost = (F.col("critical") * 10 + F.col("high") * 5).cast("decimal(10,2)") / 100
    a = a.withColumn("base", base).withColumn("final", F.least(one, (base + boost).cast("decimal(10,2)")))
    f = F.col("final")
    return a.select(
        "acct", "violations", "critical", "high", F.col("base").cast("double").alias("base_score"), f.cast("double").alias("final_score"),
        F.when(f >= 0.75, "BLOCK").when(f >= 0.5, "HOLD FOR REVIEW").when(f >= 0.3, "MONITOR").otherwise("ALLOW").alias("action"),
        F.when(f >= 0.75, "HIGH").when(f >= 0.5, "MEDIUM").when(f >= 0.3, "LOW").otherwise("NORMAL").alias("risk"),
    )


def rule_features(l: DataFrame) -> DataFrame:
    """One column per rule number 1-12 (8 and 9 are reserved), 1 if it fired."""
    v = violations(l).groupBy("acct").agg(F.collect_set("rule").alias("r"))
    a = l.select("acct").distinct().join(v, "acct", "left")
    return a.select("acct", *[F.coalesce(F.array_contains("r", F.lit(k).cast("long")), F.lit(False)).cast("long").alias(f"r{k}") for k in range(1, 13)])


def _alert(df: DataFrame, kind: str, severity: str, who: str = "acct") -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.col(who).cast("string").alias("subject"), stamp("at").alias("at"), F.col("what").cast("string").alias("what"))


def pattern_rapid(l: DataFrame, cfg: AmlConfig = MNT) -> DataFrame:
    gap = (micros("ts") - F.lag(micros("ts")).over(by_account())) / 6e7
    hit = l.withColumn("gap", gap).where((F.col("gap") < cfg.rapid_minutes) & (F.col("amount") > cfg.high_value))
    return _alert(_first(hit, ["ts", "id"], 3).select("acct", F.col("ts").alias("at"), F.col("id").alias("what")), "RAPID", "HIGH")


def pattern_round_trip(l: DataFrame) -> DataFrame:
    """Each row with a row of opposite type within five percent among the ten before it; the newest match; three per account."""
    w = by_account().rowsBetween(-10, -1)
    past = F.collect_list(F.struct("id", "type", "amt")).over(w)
    hit = l.withColumn("past", past).withColumn("m", F.expr("try_element_at(filter(past, x -> (x.type = 'credit') <> (type = 'credit') and abs(x.amt - amt) < x.amt * 0.05), -1).id")).where("m is not null")
    return _alert(_first(hit, ["ts", "id"], 3).select("acct", F.col("ts").alias("at"), F.col("m").alias("what")), "ROUND_TRIP", "HIGH")


def pattern_smurfing(l: DataFrame, cfg: AmlConfig = MNT) -> DataFrame:
    return _alert(smurf_days(l, cfg).select("acct", F.col("t1").alias("at"), F.col("sources").alias("what")), "SMURFING", "CRITICAL")


def pattern_burst(calls: DataFrame, cfg: AmlConfig = MNT) -> DataFrame:
    """Five calls of a number within half an hour; the window starts anew after a hit; three per number.

    The first five-call window is the first hit; the next hit is the first window that begins
    after it, and once more: minima with map-side combination, no list of a number's calls."""
    w = Window.partitionBy("acct").orderBy("t", "id")
    c = calls.where("callerNumber is not null and startTime is not null").select(F.col("callerNumber").alias("acct"), micros("startTime").alias("t"), "id")
    c = c.withColumn("rn", F.row_number().over(w)).withColumn("t0", F.lag("t", 4).over(w)).where(F.col("t") - F.col("t0") < int(cfg.burst_minutes * 60_000_000))
    first = F.min(F.struct("rn", "t0", (F.col("t") - F.col("t0")).alias("d"))).alias("h")
    hits = [c.groupBy("acct").agg(first)]
    for _ in range(2):
        after = hits[-1].select("acct", F.col("h.rn").alias("last"))
        hits.append(c.join(after, "acct").where("rn >= last + 5").groupBy("acct").agg(first))
    x = reduce(DataFrame.unionByName, hits)
    return _alert(x.select("acct", F.timestamp_micros("h.t0").alias("at"), F.col("h.d").alias("what")), "BURST", "MEDIUM")


def top_alerts(l: DataFrame, calls: DataFrame, cfg: AmlConfig = MNT, k: int = 100) -> DataFrame:
    alerts = reduce(DataFrame.unionByName, [pattern_rapid(l, cfg), pattern_round_trip(l), pattern_smurfing(l, cfg), pattern_burst(calls, cfg)])
    rank = F.when(F.col("severity") == "CRITICAL", 3).when(F.col("severity") == "HIGH", 2).otherwise(1)
    return alerts.orderBy(rank.desc(), F.desc("at"), "kind", "subject", "what").limit(k)


def drill_down(l: DataFrame, minutes: int = 10) -> DataFrame:
    """Every flagged transaction with the number of neighbours of its account within so many minutes (both ends included)."""
    w = Window.partitionBy("acct").orderBy("us").rangeBetween(-minutes * 60_000_000, minutes * 60_000_000)
    return l.withColumn("us", micros("ts")).withColumn("n", F.count("*").over(w) - 1).where("flagStatus = 'SUSPICIOUS'").select("id", "acct", F.col("n").alias("neighbours"))
