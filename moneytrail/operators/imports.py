"""Import of bank, call and access-log files: rows with their status, counted like the importer's summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.functions.scalars import apply_time_of_day, clean_amount, read_datetime, unwrap_caller


def _cell(data: str, field: str) -> Column:
    v = F.try_element_at(F.col(data), F.lit(field))
    return F.when(F.trim(v) != "", F.trim(v))


def import_bank(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(fileid, lineno, status, ts_us, type, amount, ...) of rows (fileid, lineno, data: field -> text; data is
    null for a line that doesn't parse).

    SKIPPED: no parse, no date, an opening balance, or no amount; DUPLICATE: a reference of the account imported
    before (without an account, in the same file), or a fingerprint stored as often already; else IMPORTED.
    Split amounts: a positive credit wins, else the debit; signed ones: 0 and more is credit.  The balance after
    is the stated one, else that before with the amount added or taken."""
    g = lambda f: _cell("data", f)
    us = apply_time_of_day(read_datetime(F.coalesce(g("date"), g("datetime"))), g("time"))
    credit, debit, signed = clean_amount(g("credit")), clean_amount(g("debit")), clean_amount(g("amount"))
    split = F.map_contains_key("data", "credit") | F.map_contains_key("data", "debit")
    x = rows.select(
        "fileid", "lineno", us.alias("ts_us"), F.when(F.when(split, credit > 0).otherwise(signed >= 0), "credit").otherwise("debit").alias("type"),
        F.when(split, F.when(credit > 0, credit).otherwise(F.abs(debit))).otherwise(F.abs(signed)).alias("amount"),
        g("account").alias("account"), g("counterpartyAccount").alias("cp"), g("counterpartyName").alias("cp_name"), g("description").alias("description"), g("reference").alias("ref"),
        F.upper(F.coalesce(g("currency"), F.lit("MNT"))).alias("currency"), g("counterpartyNationalId").alias("cp_nat"), g("category").alias("category"), g("channel").alias("channel"),
        *(F.when(g(c).isNotNull(), clean_amount(g(c))).alias(c) for c in ("balance", "balanceBefore")), F.when(split, (credit > 0) | (debit != 0)).otherwise(g("amount").isNotNull()).alias("has_amount"),
    )
    skip = F.col("ts_us").isNull() | F.coalesce(~F.col("has_amount"), F.lit(True)) | F.coalesce(F.col("description").contains("Эхний үлдэгдэл"), F.lit(False))
    after = F.col("balanceBefore") + F.when(F.col("type") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    x = x.withColumn("skip", skip).withColumn("balance", F.coalesce("balance", after)).drop("balanceBefore")
    # the first imported row of each reference, by a minimum with map-side combination
    at = F.struct("fileid", "lineno")
    key = {"_owner": F.coalesce(F.concat(F.lit("a"), F.col("account")), F.concat(F.lit("f"), F.col("fileid").cast("string"))), "_ref": F.col("ref")}
    x = x.withColumns(key)
    first = x.where("ref is not null and not skip").groupBy("_owner", "_ref").agg(F.min(at).alias("_first"))
    x = x.join(first, ["_owner", "_ref"], "left").withColumn("again", F.coalesce(~F.col("skip") & (at > F.col("_first")), F.lit(False))).drop("_owner", "_ref", "_first")
    finger = ["ts_us", "type", "cents", "cp", "description"]
    x = x.withColumn("cents", F.round(F.col("amount") * 100).cast("long"))
    if stored is not None:
        have = stored.groupBy(*finger).agg(F.count("*").alias("have")).select(*[F.col(c).alias(f"_{c}") for c in finger], "have")
        occurrence = F.row_number().over(Window.partitionBy(*finger).orderBy("fileid", "lineno"))
        x = x.withColumn("occurrence", occurrence).join(have, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in finger], "left")
        x = x.withColumn("again", F.col("again") | (F.col("occurrence") <= F.coalesce("have", F.lit(0)))).drop("occurrence", "have", *[f"_{c}" for c in finger])
    status = F.when(F.col("skip"), "SKIPPED").when(F.col("again"), "DUPLICATE").otherwise("IMPORTED")
    return x.withColumn("status", status).drop("skip", "again", "has_amount")


def import_calls(rows: DataFrame, as_of_us: int, minutes: bool = True, most: int = 500) -> DataFrame:
    """One row per call: rows without a called or caller number are skipped, undated ones stamped as_of_us,
    a frequency repeats its row (at most so many times); direction is always Outgoing."""
    g = lambda f: _cell("data", f)
    duration = F.regexp_replace(g("duration"), ",", "").try_cast("double")
    times = F.least(F.lit(most), F.greatest(F.lit(1), F.coalesce(F.regexp_replace(g("frequency"), r"\D", "").try_cast("int"), F.lit(1))))
    x = rows.select(
        "fileid", "lineno", unwrap_caller(g("caller")).alias("caller"), unwrap_caller(g("called")).alias("called"), F.coalesce(read_datetime(g("datetime")), F.lit(as_of_us)).alias("ts_us"),
        F.coalesce(F.floor(duration * (60 if minutes else 1) + 0.5).cast("long"), F.lit(0)).alias("seconds"), F.lit("Outgoing").alias("direction"), times.alias("times"),
    )
    return x.where("caller <> '' and called <> ''").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")


def import_access(rows: DataFrame) -> DataFrame:
    """One row per (time, user, address), a missing address equal to a missing one; rows without time or user are skipped."""
    g = lambda f: _cell("data", f)
    x = rows.select("fileid", "lineno", read_datetime(g("timestamp")).alias("ts_us"), g("accountId").alias("user"), g("ip").alias("ip"), g("deviceModel").alias("device")).where("ts_us is not null and user is not null")
    n = F.row_number().over(Window.partitionBy("ts_us", "user", "ip").orderBy("fileid", "lineno"))
    return x.withColumn("n", n).where("n = 1").drop("n")


def summary(imported: DataFrame) -> DataFrame:
    """Rows by status of each file; a file without lines has a row of zeros if imported holds one without lineno."""
    return imported.withColumn("status", F.when(F.col("lineno").isNotNull(), F.col("status"))).groupBy("fileid").agg(
        F.count("lineno").alias("total"), F.count_if(F.col("status") == "IMPORTED").alias("imported"), F.count_if(F.col("status") == "SKIPPED").alias("skipped"), F.count_if(F.col("status") == "DUPLICATE").alias("duplicate")
    )
