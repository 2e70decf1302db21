"""Sinks: tables, CSV and XML exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """RFC 4180: quotes doubled, header in each file."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_chart_xml(entities: DataFrame, path: str) -> None:
    """Chart nodes (id, fullName, x, y) as XML rows."""
    node = entities.select(F.col("id").alias("_Id"), F.col("fullName").alias("_Label"), F.col("x").alias("_X"), F.col("y").alias("_Y"))
    node.write.mode("overwrite").option("rowTag", "ChartItem").option("rootTag", "Chart").xml(path)


def export_sheets(ledger: DataFrame, suspects: DataFrame, accounts: DataFrame, calls: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """The sheets of the workbook export with looked-up names, missing texts as ''."""
    names = suspects.select(F.col("id").alias("suspectId"), "fullName")
    acc = accounts.select(F.col("id").alias("acct"), "accountNumber", "suspectId").join(names, "suspectId", "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    return {
        "Suspects": suspects.select("suspectId", "fullName", text("nationalId").alias("nationalId"), text("riskLevel").alias("riskLevel"), text("status").alias("status")),
        "Transactions": ledger.join(acc, "acct", "left").select(text("accountNumber").alias("account"), text("fullName").alias("owner"), "ts", "type", "amount", text("cp").alias("counterparty")),
        "Call Records": calls.join(names, "suspectId", "left").select(text("fullName").alias("suspect"), "callerNumber", "calledNumber", "startTime", "durationSeconds"),
        "Network Links": links,
    }
