"""Scopes with evidence, report qualification and rankings, orders with limits, links replaced and tagged, drill-down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.operators.casework import dashboard
from moneytrail.operators.ledger import is_credit, micros, stamp, total
from moneytrail.operators.network import phone8


def lookup(df: DataFrame, value: int, key: str = "id") -> DataFrame:
    return df.where(F.col(key) == value)


def paged_with_total(df: DataFrame, page: int, size: int) -> DataFrame:
    """A page, newest first, each row with the number of all rows; no rows beyond the last page."""
    n = df.agg(F.count("*").alias("total_count"))  # one row
    return df.orderBy(F.desc("ts"), F.desc("id")).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(n))


def locations_since(l: DataFrame, since: str | None) -> DataFrame:
    """Transactions with a location, from a time on if one is given."""
    x = l.where("location is not null and location <> ''")
    return x if since is None else x.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))


def audit_search(events: DataFrame, start: str | None = None, end: str | None = None, actor: str | None = None, action: str | None = None, take: int = 1000) -> DataFrame:
    """Entries in a period whose actor and action contain the texts, the newest first; take is held to 1-50,000."""
    x = events
    for c, op in ((start, ">="), (end, "<=")):
        if c is not None:
            x = x.where(F.col("at") >= c) if op == ">=" else x.where(F.col("at") <= c)
    for c, text in (("actor", actor), ("action", action)):
        if text:
            x = x.where(F.lower(c).contains(text.lower()))
    return x.orderBy(F.desc("id")).limit(min(50_000, max(1, take)))


def person_columns(suspects: DataFrame, today: str, born: Column) -> DataFrame:
    """(id, initials, age): first letters of the first and last word of the name; whole years of 365.25 days."""
    words = F.filter(F.split(F.trim("fullName"), r"\s+"), lambda w: w != "")
    initials = F.when(F.size(words) >= 2, F.concat(F.left(words[0], F.lit(1)), F.left(F.element_at(words, -1), F.lit(1)))).otherwise(F.left(F.get(words, F.lit(0)), F.lit(1)))
    age = F.floor(F.datediff(F.lit(today).cast("date"), born) / 365.25)
    return suspects.select("id", F.upper(initials).alias("initials"), age.cast("long").alias("age"))


def evidence_scope(l: DataFrame, suspects: DataFrame, accounts: DataFrame, evidence: DataFrame, cases: list[str] | None) -> DataFrame:
    """Transactions in the scope of cases: of accounts of their suspects (by case or evidence), of accounts or
    themselves in evidence (caseId, sourceType, sourceId).  None is unrestricted, [] empty.  The
    disjunction is a union of ids and one semi join."""
    if cases is None:
        return l
    e = evidence.where(F.col("caseId").isin(cases))
    of = lambda kind: e.where(F.col("sourceType") == kind).select(F.col("sourceId").alias("id"))
    s = suspects.where(F.col("caseId").isin(cases)).select("id").unionByName(of("SUSPECT")).distinct()
    a = accounts.join(s.select(F.col("id").alias("suspectId")), "suspectId", "left_semi").select("id").unionByName(of("ACCOUNT")).distinct()
    ids = l.join(a.select(F.col("id").alias("acct")), "acct", "left_semi").select("id").unionByName(of("TXN")).distinct()
    return l.join(ids, "id", "left_semi")


def scoped_cases(owned: DataFrame, members: DataFrame, user: int | None, admin: bool = False) -> DataFrame | None:
    """The cases a user may see: None (all) for an administrator, those owned or granted, none for nobody."""
    if admin:
        return None
    mine = lambda d: d.where(F.col("userId") == (-1 if user is None else user)).select("caseId")
    return mine(owned).unionByName(mine(members)).distinct()


def links_in_scope(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links (a, b) of which both ends are in ids (id)."""
    return links.join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b")), "b", "left_semi")


def scoped_dashboard(l: DataFrame, suspects: DataFrame, calls: DataFrame, accounts: DataFrame, cases: list[str]) -> DataFrame:
    """The dashboard over what the cases' suspects own."""
    s = suspects.where(F.col("caseId").isin(cases))
    own = s.select(F.col("id").alias("suspectId"))
    a, c = accounts.join(own, "suspectId", "left_semi"), calls.join(own, "suspectId", "left_semi")
    return dashboard(l.join(a.select(F.col("id").alias("acct")), "acct", "left_semi"), s, c, a)


def first_evidence_per_case(evidence: DataFrame, cases: DataFrame) -> DataFrame:
    """(caseId, sourceId, title): the first entry of each case (by exhibit), with the case's title."""
    first = evidence.groupBy("caseId").agg(F.min_by("sourceId", F.struct("exhibit", "sourceId")).alias("sourceId"))
    return first.join(cases.select("caseId", "title"), "caseId")


def calls_of(suspects: DataFrame, calls: DataFrame) -> DataFrame:
    """(suspect, call): each call that is a suspect's by its suspectId or by a phone of theirs, once."""
    phones = suspects.select(F.col("id").alias("suspect"), phone8("primaryPhone").alias("k")).where("k is not null")
    by_id = calls.join(suspects.select(F.col("id").alias("suspectId")), "suspectId", "left_semi").select(F.col("suspectId").alias("suspect"), F.col("id").alias("call"))
    ends = calls.select(F.col("id").alias("call"), F.explode(F.array(phone8("callerNumber"), phone8("calledNumber"))).alias("k")).where("k is not null")
    return by_id.unionByName(ends.join(phones, "k").select("suspect", "call")).distinct()


def qualified_transfers(l: DataFrame, accounts: DataFrame, suspects: DataFrame, least: float) -> DataFrame:
    """Transactions for a report: a counterparty account, at least so large, one side's owner under investigation."""
    owner = accounts.join(suspects.select(F.col("id").alias("suspectId"), (F.col("status") == "UNDER_INVESTIGATION").alias("open")), "suspectId")
    mine = owner.select(F.col("id").alias("acct"), F.col("open").alias("mine"))
    theirs = owner.select(F.trim("accountNumber").alias("no"), "open").groupBy("no").agg(F.bool_or("open").alias("theirs"))
    x = l.where(F.col("amount") >= least).withColumn("no", F.trim("cp")).where("no <> ''")
    return x.join(mine, "acct", "left").join(theirs, "no", "left").where("coalesce(mine, false) or coalesce(theirs, false)")


def flow_ranking(relations: DataFrame, top: int = 15) -> DataFrame:
    """Each relation (key, credit, debit) as an incoming and an outgoing flow, the largest first."""
    flows = F.array(F.struct(F.lit("IN").alias("flow"), F.col("credit").alias("value")), F.struct(F.lit("OUT").alias("flow"), F.col("debit").alias("value")))
    x = relations.select("key", F.explode(flows).alias("f")).select("key", "f.flow", "f.value").where("value > 0")
    return x.orderBy(F.desc("value"), "key", "flow").limit(top)


def period(l: DataFrame) -> DataFrame:
    return l.agg(stamp(F.min("ts")).alias("first_at"), stamp(F.max("ts")).alias("last_at"))


def owner_ordered(stats: DataFrame, top: int) -> DataFrame:
    """Accounts (acct, owner, n) with owners by their busiest account, within an owner the busiest first; accounts without an owner alone."""
    key = F.coalesce(F.concat(F.lit("o:"), "owner"), F.concat(F.lit("a:"), F.col("acct").cast("string")))
    x = stats.withColumn("_k", key)
    most = x.groupBy("_k").agg(F.max("n").alias("busiest"))
    return x.join(most, "_k").orderBy(F.desc("busiest"), "_k", F.desc("n"), "acct").drop("_k").limit(top)


def replaced_links(stored: DataFrame, new: DataFrame, kinds: list[str]) -> DataFrame:
    """Stored links (kind, a, b) without the generated kinds, and the new ones."""
    return stored.where(~F.col("kind").isin(kinds)).unionByName(new)


def tagged(evidence: DataFrame, new: DataFrame) -> DataFrame:
    """Evidence (caseId, sourceType, sourceId, exhibit) with new sources added once, numbered after the highest of their case."""
    key = ["caseId", "sourceType", "sourceId"]
    fresh = new.select(*key).distinct().join(evidence.select(*key), key, "left_anti")
    top = evidence.groupBy("caseId").agg(F.max("exhibit").alias("top"))
    n = F.row_number().over(Window.partitionBy("caseId").orderBy("sourceType", "sourceId"))
    added = fresh.withColumn("n", n).join(top, "caseId", "left").select(*key, (F.coalesce("top", F.lit(0)) + F.col("n")).cast("long").alias("exhibit"))
    return evidence.select(*key, F.col("exhibit").cast("long").alias("exhibit")).unionByName(added)


def delete_case(l: DataFrame, suspects: DataFrame, accounts: DataFrame, calls: DataFrame, case: str) -> dict[str, DataFrame]:
    """The tables after a case is deleted: suspects of no other case go (by national id), with accounts, transactions and calls."""
    mine = suspects.where(F.col("caseId") == case)
    others = suspects.where((F.col("caseId") != case) & F.col("nationalId").isNotNull()).select("nationalId")
    gone = mine.join(others, "nationalId", "left_anti").select("id")
    a = accounts.join(gone.select(F.col("id").alias("suspectId")), "suspectId", "left_semi").select("id")
    return {
        "suspects": suspects.join(gone, "id", "left_anti"), "accounts": accounts.join(a, "id", "left_anti"),
        "transactions": l.join(a.select(F.col("id").alias("acct")), "acct", "left_anti"), "calls": calls.join(gone.select(F.col("id").alias("suspectId")), "suspectId", "left_anti"),
    }


def flow_nodes(flows: DataFrame, accounts: DataFrame, suspects: DataFrame) -> DataFrame:
    """Nodes of the largest flows (acct, cp, value; at most as many as the flow query keeps) in order of appearance,
    coloured by the risk of an account's owner."""
    w = Window.orderBy(F.desc("value"), "acct", "cp")  # the few flows of a chart
    f = flows.select("acct", "cp", F.row_number().over(w).alias("rn"))
    nodes = f.select(F.concat(F.lit("a:"), F.col("acct").cast("string")).alias("node"), (F.col("rn") * 2).alias("at"), "acct").unionByName(f.select(F.concat(F.lit("c:"), "cp").alias("node"), (F.col("rn") * 2 + 1).alias("at"), F.lit(None).cast("long").alias("acct")))
    g = nodes.groupBy("node").agg(F.min("at").alias("at"), F.max("acct").alias("acct"))
    risk = accounts.select(F.col("id").alias("acct"), "suspectId").join(suspects.select(F.col("id").alias("suspectId"), "riskLevel"), "suspectId").select("acct", "riskLevel")
    colour = F.when(F.col("riskLevel").isin("CRITICAL", "HIGH"), "red").when(F.col("riskLevel") == "MEDIUM", "orange").when(F.col("riskLevel") == "LOW", "green").otherwise("grey")
    return g.join(risk, "acct", "left").select("node", (F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("index"), colour.alias("colour"))


def drill_down_rows(l: DataFrame, minutes: int = 10) -> DataFrame:
    """(target, related, minutes): each flagged transaction with those of its account within so many minutes, itself
    left out: an equi join on account and time slot (the related stand in their own and both neighbouring slots)."""
    slot = minutes * 60_000_000
    t = l.withColumn("us", micros("ts")).withColumn("slot", F.expr(f"us div {slot}"))
    target = t.where("flagStatus = 'SUSPICIOUS'").select(F.col("id").alias("target"), "acct", F.col("us").alias("tu"), "slot")
    near = t.select(F.col("id").alias("related"), "acct", "us", F.explode(F.expr("array(slot - 1, slot, slot + 1)")).alias("slot"))
    x = target.join(near, ["acct", "slot"]).where((F.abs(F.col("us") - F.col("tu")) <= slot) & (F.col("target") != F.col("related")))
    return x.select("target", "related", (F.floor((F.col("us") - F.col("tu")) / 6000) / 10000.0).alias("minutes"))


def strongest_links(links: DataFrame) -> DataFrame:
    """Cells (row, col) over links (kind, a, b, n, seconds, weight): events, those of communication, the kind of the heaviest link (the first on ties)."""
    two = links.select(F.col("a").alias("row"), F.col("b").alias("col"), "kind", "n", "weight").unionByName(links.select(F.col("b").alias("row"), F.col("a").alias("col"), "kind", "n", "weight"))
    return two.groupBy("row", "col").agg(F.sum("n").alias("events"), F.coalesce(F.sum(F.when(F.col("kind") == "COMMUNICATION", F.col("n"))), F.lit(0)).alias("communications"), F.min_by("kind", F.struct(-F.col("weight"), F.col("kind"))).alias("strongest"))


def typed_links(parts: dict[str, DataFrame]) -> DataFrame:
    """Links of several kinds (a, b, n, strength) in one table (kind, a, b, n, weight)."""
    return reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("kind"), "a", "b", "n", F.col("strength").alias("weight")) for k, d in parts.items()])


def account_totals(l: DataFrame) -> DataFrame:
    return l.groupBy("acct").agg(F.count("*").alias("n"), total(F.when(is_credit(), F.col("amount"))).alias("credit"), total(F.when(~is_credit(), F.col("amount"))).alias("debit"))
