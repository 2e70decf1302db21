"""The ledger and its statistics: projections, account statistics, Benford test, account analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moneytrail.config import MNT, AmlConfig
from moneytrail.plans.session import table


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with short names; type in lower case, debit where missing."""
    return table(spark, sf_dir, "bank_transactions").select(
        "id", F.col("bankAccountId").alias("acct"), F.col("timestamp").alias("ts"), "amount", F.col("amount").cast("double").alias("amt"),
        F.lower(F.coalesce("type", F.lit("debit"))).alias("type"), "category", "description", F.col("referenceNumber").alias("ref"),
        F.col("counterpartyAccount").alias("cp"), F.col("counterpartyName").alias("cp_name"), F.col("counterpartyNationalId").alias("cp_nat"),
        "channel", "location", "currency", "flagStatus",
    ).where("acct is not null and ts is not null and amount is not null")


def micros(c: str | Column) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def stamp(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def is_credit() -> Column:
    return F.col("type") == "credit"


def total(c: Column | str = "amount") -> Column:
    """Exact decimal sum, as double."""
    return F.coalesce(F.sum(c), F.lit(0)).cast("double")


def near_threshold(cfg: AmlConfig = MNT) -> Column:
    return (F.col("amount") >= cfg.near_low) & (F.col("amount") < cfg.near_high)


def round_number(cfg: AmlConfig = MNT) -> Column:
    return (F.col("amount") >= cfg.round_min) & (F.col("amount") % cfg.round_modulus == 0)


def off_hours(cfg: AmlConfig = MNT) -> Column:
    h = F.hour("ts")
    return (h >= cfg.night_start) & (h < cfg.night_end)


def night_hour(start: int = 0, end: int = 6, c: str = "ts") -> Column:
    """Both ends included; a window may run over midnight."""
    h = F.hour(c)
    return h.between(start, end) if start <= end else (h >= start) | (h <= end)


def weekend() -> Column:
    return F.dayofweek("ts").isin(1, 7)


def leading_digit(c: str = "amount") -> Column:
    """First digit of |x|, 0 below 1."""
    a = F.abs(c)
    return F.when(a >= 1, F.substring(a.cast("string"), 1, 1).cast("int")).otherwise(0)


# Expected shares of leading digits, in percent.
BENFORD = [30.1, 17.6, 12.5, 9.7, 7.9, 6.7, 5.8, 5.1, 4.6]


def account_statistics(l: DataFrame) -> DataFrame:
    """Per account: counts, sums, exact median, spread, peaks (first of ties).  Empty: no row.

    The median comes from a running count over an account's distinct amounts, which is streamed in
    order; no buffer holds an account."""
    buckets = l.groupBy("acct", F.hour("ts").alias("h"), (F.dayofweek("ts") - 1).alias("d")).agg(F.count("*").alias("n"))  # at most 168 rows an account
    peak = lambda c, name: buckets.groupBy("acct", F.col(c).alias("b")).agg(F.sum("n").alias("n")).groupBy("acct").agg(F.max_by("b", F.struct("n", -F.col("b"))).cast("long").alias(name))
    credit, debit = total(F.when(is_credit(), F.col("amount"))), total(F.when(~is_credit(), F.col("amount")))
    s = l.groupBy("acct").agg(
        F.count("*").alias("n"), total().alias("total"), F.max("amt").alias("max_amount"), F.min("amt").alias("min_amount"),
        F.round(F.coalesce(F.stddev_samp("amt"), F.lit(0.0)), 2).alias("std_dev"), credit.alias("credits"), debit.alias("debits"),
        F.count_if(is_credit()).alias("credit_count"), F.count_if(~is_credit()).alias("debit_count"),
    )
    upto = Window.partitionBy("acct").orderBy("amt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a = l.groupBy("acct", "amt").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(upto))
    a = a.join(s.select("acct", "n"), "acct")
    # the rows at places (n + 1) div 2 and n div 2 + 1, from 1
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("amt")))
    m = a.groupBy("acct").agg(F.round((at(F.expr("(n + 1) div 2")) + at(F.expr("n div 2 + 1"))) / 2, 4).alias("median"))
    s = s.join(m, "acct").select("acct", "n", "total", "median", *[c for c in s.columns if c not in ("acct", "n", "total")])
    return (
        s.withColumn("average", F.col("total") / F.col("n"))
        .withColumn("debit_credit_ratio", F.when(F.col("credits") > 0, F.round(F.col("debits") / F.col("credits"), 6)).otherwise(0.0))
        .withColumn("net_flow", F.round(F.col("credits") - F.col("debits"), 2))
        .join(peak("h", "peak_hour"), "acct")
        .join(peak("d", "peak_day"), "acct")
    )


def hourly_distribution(l: DataFrame) -> DataFrame:
    """24 rows, hours without transactions included."""
    spine = l.sparkSession.range(24).select(F.col("id").alias("hour"))
    got = l.groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))
    return spine.join(F.broadcast(got), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"))  # got: 24 rows


def weekday_distribution(l: DataFrame) -> DataFrame:
    spine = l.sparkSession.range(7).select(F.col("id").alias("weekday"))
    got = l.groupBy((F.dayofweek("ts") - 1).cast("long").alias("weekday")).agg(F.count("*").alias("n"))
    return spine.join(F.broadcast(got), "weekday", "left").select("weekday", F.coalesce("n", F.lit(0)).cast("long").alias("n"))  # got: 7 rows


def top_recipients(l: DataFrame, k: int = 10) -> DataFrame:
    """Per account the k counterparties with the largest totals, named as in their first row."""
    g = l.where("cp is not null and cp <> ''").groupBy("acct", "cp").agg(
        total().alias("total"), F.count("*").alias("n"), F.min_by(F.coalesce("cp_name", "cp"), F.struct("ts", "id")).alias("name")
    )
    w = Window.partitionBy("acct").orderBy(F.desc("total"), "cp")
    return g.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def category_breakdown(l: DataFrame) -> DataFrame:
    return l.groupBy(F.coalesce("category", F.lit("Other")).alias("category")).agg(F.count("*").alias("n"), total().alias("total"))


def channel_breakdown(l: DataFrame) -> DataFrame:
    return l.groupBy(F.coalesce("channel", F.lit("Unknown")).alias("channel")).agg(F.count("*").alias("n"), total().alias("total"))


def monthly_trend(l: DataFrame) -> DataFrame:
    return l.groupBy("acct", F.date_format("ts", "yyyy-MM").alias("month")).agg(
        total(F.when(is_credit(), F.col("amount"))).alias("credits"), total(F.when(~is_credit(), F.col("amount"))).alias("debits"), F.count("*").alias("n")
    )


def benford_digits(l: DataFrame) -> DataFrame:
    d = leading_digit()
    return l.withColumn("d", d).where("d between 1 and 9").groupBy("acct").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("d") == k).alias(f"d{k}") for k in range(1, 10)]
    )


def benford_test(l: DataFrame) -> DataFrame:
    """chi squared against the expected shares, its p-value (8 degrees: a closed form), passed above 0.05;
    accounts with fewer than ten digits pass with (0, 1)."""
    b = benford_digits(l)
    chi = sum(((F.col(f"d{k}") - F.col("n") * (e / 100)) ** 2) / (F.col("n") * (e / 100)) for k, e in enumerate(BENFORD, 1))
    x = F.col("chi") / 2
    p = F.exp(-x) * (1 + x + x * x / 2 + x * x * x / 6)
    few = F.col("n") < 10
    return (
        b.withColumn("chi", chi)
        .withColumn("p", F.when(few, 1.0).otherwise(p))
        .select("acct", "n", F.when(few, 0.0).otherwise(F.round("chi", 6)).alias("chi_square"), F.round("p", 6).alias("p_value"), (few | (F.col("p") > 0.05)).alias("passes"))
    )


def benford_observed(l: DataFrame) -> DataFrame:
    b = benford_digits(l)
    pairs = F.array(*[F.struct(F.lit(k).alias("digit"), F.col(f"d{k}").alias("c")) for k in range(1, 10)])
    return b.select("acct", "n", F.explode(pairs).alias("p")).select("acct", F.col("p.digit").cast("long").alias("digit"), F.round(F.col("p.c") * 100.0 / F.col("n"), 6).alias("observed"))


def account_analysis(l: DataFrame, cfg: AmlConfig = MNT) -> DataFrame:
    """Six scores, overall risk and verdict of each account with transactions."""
    day = l.groupBy("acct", F.to_date("ts").alias("d")).agg(F.count("*").alias("n")).groupBy("acct").agg(F.max("n").alias("max_per_day"))
    week = l.groupBy("acct", F.weekofyear("ts").alias("w")).agg(F.count("*").alias("n")).groupBy("acct").agg(F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("weekly_std"))
    a = l.groupBy("acct").agg(
        F.count("*").alias("n"), total().alias("total"), F.coalesce(F.stddev_samp("amt"), F.lit(0.0)).alias("sd"), ((F.max(micros("ts")) - F.min(micros("ts"))) / 8.64e10).alias("days"),
        F.count_if(round_number(cfg)).alias("round_n"), F.count_if(off_hours(cfg)).alias("off_n"), F.count_if(near_threshold(cfg)).alias("near_n"), F.count_if(weekend()).alias("weekend_n"),
        (F.count_distinct("category") + F.max(F.col("category").isNull().cast("int"))).alias("categories"),
    )
    pct = lambda c: F.col(c) * 100.0 / F.col("n")
    cap = lambda c: F.least(F.lit(100.0), c)
    mean = F.col("total") / F.col("n")
    a = (
        a.withColumn("per_day", F.when(F.col("days") > 0, F.col("n") / F.col("days")).otherwise(F.col("n").cast("double")))
        .withColumn("velocity", cap(F.col("per_day") * 10))
        .withColumn("variance", F.when(mean > 0, cap(F.col("sd") / mean * 100)).otherwise(0.0))
        .withColumn("round_pct", pct("round_n"))
        .withColumn("off_pct", pct("off_n"))
        .withColumn("near_pct", pct("near_n"))
        .withColumn("overall", (F.col("velocity") + F.col("variance") + F.col("round_pct") + cap(F.col("off_pct") * 2) + cap(F.col("near_pct") * 5) + cap(F.col("categories") * 10.0)) / 6)
        .join(day, "acct").join(week, "acct").join(benford_test(l).select("acct", "passes"), "acct", "left")
    )
    flags = F.concat_ws(
        "; ", F.when(~F.coalesce("passes", F.lit(True)), "Benford's Law deviation"), F.when(F.col("near_pct") > 10, "Potential structuring"),
        F.when(F.col("round_pct") > 30, "Excessive round amounts"), F.when(F.col("off_pct") > 40, "High off-hours activity"), F.when(F.col("per_day") > 5, "High velocity"),
    )
    return a.select(
        "acct", "n", F.round("per_day", 6).alias("avg_per_day"), "max_per_day", F.round("weekly_std", 6).alias("weekly_std"), F.round("velocity", 4).alias("velocity_score"),
        F.round("variance", 3).alias("variance_score"), F.round("round_pct", 4).alias("round_pct"), F.round("off_pct", 4).alias("off_pct"), F.round("near_pct", 4).alias("near_pct"), "weekend_n", F.col("categories").cast("long").alias("categories"),
        F.round("overall", 3).alias("overall"), F.when(F.col("overall") >= 60, "HIGH").when(F.col("overall") >= 35, "MEDIUM").otherwise("LOW").alias("risk"),
        F.when(flags == "", "No significant anomalies detected").otherwise(flags).alias("verdict"),
    )
