"""Screening, scope and noise, set operations, deletion and merging, audit chain, dashboard, scans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.operators.ledger import is_credit, micros, total


def dashboard(l: DataFrame, suspects: DataFrame, calls: DataFrame, accounts: DataFrame) -> DataFrame:
    t = l.agg(F.count("*").alias("transactions"), total().alias("volume"), F.count_if(F.col("flagStatus").isin("SUSPICIOUS", "REVIEW")).alias("flagged"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_at"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_at"))
    s = suspects.agg(F.count("*").alias("suspects"), F.count_if(F.col("riskLevel").isin("HIGH", "CRITICAL")).alias("high_risk"), F.count_if(F.col("status") == "UNDER_INVESTIGATION").alias("open"))
    c, a = calls.agg(F.count("*").alias("calls")), accounts.agg(F.count("*").alias("accounts"))
    return t.crossJoin(s).crossJoin(c).crossJoin(a)  # one row each


def record_stats(l: DataFrame, accounts: DataFrame, suspects: DataFrame) -> DataFrame:
    """Accounts with transactions: count, first and last, owner (holder name, else the suspect's)."""
    g = l.groupBy("acct").agg(F.count("*").alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    a = accounts.select(F.col("id").alias("acct"), "accountNumber", "bankName", "accountHolderName", "suspectId").join(suspects.select(F.col("id").alias("suspectId"), "fullName"), "suspectId", "left")
    return g.join(a, "acct").select("acct", "accountNumber", "bankName", F.coalesce("accountHolderName", "fullName").alias("owner"), "n", F.date_format("t0", "yyyy-MM-dd HH:mm:ss").alias("first_at"), F.date_format("t1", "yyyy-MM-dd HH:mm:ss").alias("last_at"))


def suspect_holdings(suspects: DataFrame, accounts: DataFrame) -> DataFrame:
    """Suspects with their accounts as a sorted list, empty where they have none."""
    a = accounts.where("suspectId is not null").groupBy(F.col("suspectId").alias("id")).agg(F.concat_ws(",", F.array_sort(F.collect_list("accountNumber"))).alias("accounts"), F.count("*").alias("n"))
    return suspects.select("id", "fullName").join(a, "id", "left").select("id", "fullName", F.coalesce("accounts", F.lit("")).alias("accounts"), F.coalesce("n", F.lit(0)).alias("n"))


def noise_ids(l: DataFrame, min_amount: float, rules: list[tuple[str, str]]) -> Column:
    """A row is noise if its amount is small or its description matches a rule (starts, ends, includes)."""
    d = F.lower(F.coalesce("description", F.lit("")))
    out = F.col("amount") < min_amount
    for mode, text in rules:
        t = text.lower()
        out = out | (d.startswith(t) if mode == "starts" else d.endswith(t) if mode == "ends" else d.contains(t))
    return out


def noise_filter(l: DataFrame, min_amount: float, rules: list[tuple[str, str]], pairs: DataFrame) -> DataFrame:
    """Transactions that are kept; pairs (acct, cp) are ignored as a whole."""
    kept = l.where(~noise_ids(l, min_amount, rules))
    return kept.join(pairs, ["acct", "cp"], "left_anti")


def case_scope(l: DataFrame, suspects: DataFrame, accounts: DataFrame, cases: list[str] | None) -> DataFrame:
    """Transactions of accounts of suspects of the cases; None is unrestricted, [] empty."""
    if cases is None:
        return l
    s = suspects.where(F.col("caseId").isin(cases)).select(F.col("id").alias("suspectId"))
    a = accounts.join(s, "suspectId", "left_semi").select(F.col("id").alias("acct"))
    return l.join(a, "acct", "left_semi")


def purge_plan(l: DataFrame, suspects: DataFrame, accounts: DataFrame, case: str) -> DataFrame:
    """What deleting a case would remove: suspects in it whose national id is in no other case, with accounts and rows."""
    mine = suspects.where(F.col("caseId") == case)
    others = suspects.where((F.col("caseId") != case) & F.col("nationalId").isNotNull()).select("nationalId")
    gone = mine.join(others, "nationalId", "left_anti").select(F.col("id").alias("suspectId"))
    acc = accounts.join(gone, "suspectId", "left_semi").select(F.col("id").alias("acct"))
    t = l.join(acc, "acct", "left_semi")
    return gone.agg(F.count("*").alias("suspects")).crossJoin(acc.agg(F.count("*").alias("accounts"))).crossJoin(t.agg(F.count("*").alias("transactions"), total().alias("volume")))  # one row each


def bag_except(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new beyond as many equal rows as are stored: the nth occurrence is kept if n exceeds the stored count."""
    have = stored.groupBy(*keys).agg(F.count("*").alias("have")).select(*[F.col(k).alias(f"_{k}") for k in keys], "have")
    n = new.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("id")))
    cond = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return n.join(have, cond, "left").where(F.col("nth") > F.coalesce("have", F.lit(0))).drop("nth", "have", *[f"_{k}" for k in keys])


def reference_dedup(l: DataFrame) -> DataFrame:
    """The first row of each (account, reference); rows without a reference are all kept."""
    n = F.row_number().over(Window.partitionBy("acct", "ref").orderBy("id"))
    return l.where("ref is null").unionByName(l.where("ref is not null").withColumn("n", n).where("n = 1").drop("n"))


def access_dedup(a: DataFrame) -> DataFrame:
    """One row per (time, user, address), a null address equal to a null address: the least id."""
    return a.groupBy("ts", "user", "address").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def merge_renumber(entries: DataFrame, target: str) -> DataFrame:
    """Entries (caseId, exhibit, id) of all cases moved to the target: its own keep their numbers, each other
    id once, numbered after the highest in order of case and number.

    The running number needs one order over the merged case: it is taken within a partition per case
    plus the counts of the cases before it, so no case's rows are gathered with another's."""
    own = entries.where(F.col("caseId") == target)
    top = F.broadcast(own.agg(F.coalesce(F.max("exhibit"), F.lit(0)).alias("top")))  # one row
    other = entries.where(F.col("caseId") != target).join(own.select("id"), "id", "left_anti")
    first = other.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("caseId", "exhibit"))).where("k = 1").drop("k")
    sizes = first.groupBy("caseId").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("caseId").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per case
    w = Window.partitionBy("caseId").orderBy("exhibit", "id")
    moved = first.withColumn("rn", F.row_number().over(w)).join(F.broadcast(before.select("caseId", "before")), "caseId").crossJoin(top)
    return own.select("id", F.col("exhibit").cast("long").alias("exhibit")).unionByName(moved.select("id", (F.col("top") + F.col("before") + F.col("rn")).cast("long").alias("exhibit")))


def delete_account(l: DataFrame, links: DataFrame, account: int) -> tuple[DataFrame, DataFrame]:
    """(transactions, links) after an account is deleted: links (id, txns) lose its transactions; those left without any go."""
    gone = l.where(F.col("acct") == account).select("id")
    kept = l.join(gone, "id", "left_anti")
    t = links.select("id", F.explode("txns").alias("txn")).join(gone.select(F.col("id").alias("txn")), "txn", "left_anti")
    return kept, t.groupBy("id").agg(F.array_sort(F.collect_list("txn")).alias("txns"))


def paged(df: DataFrame, page: int, size: int) -> DataFrame:
    return df.orderBy(F.desc("ts"), F.desc("id")).offset((page - 1) * size).limit(size)


def neighbours(l: DataFrame, account: int, around: str, minutes: int) -> DataFrame:
    """Transactions of an account within so many minutes of a time, both ends included."""
    d = F.abs(micros("ts") - F.unix_micros(F.lit(around).cast("timestamp")))
    return l.where((F.col("acct") == account) & (d <= minutes * 60_000_000))


def audit_chain(events: DataFrame) -> DataFrame:
    """Chained hashes of events (chain, id, at, actor, action, target, detail): each covers the one before.

    Appending is serial by nature: a chain is read in order by one task, which keeps only the last
    hash; chains are independent and spread over tasks."""
    payload = F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("")) for c in ("at", "actor", "action", "target", "detail")))

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, last = None, ""
        for b in batches:
            out = []
            for c, p in zip(b.chain, b.p):
                if c != chain:
                    chain, last = c, ""
                last = hashlib.sha256(f"{last}|{p}".encode()).hexdigest().upper()
                out.append(last)
            yield b.assign(hash=out)

    ordered = events.select(F.col("chain").cast("long").alias("chain"), F.col("id").cast("long").alias("id"), payload.alias("p")).repartition("chain").sortWithinPartitions("chain", "id")
    return ordered.mapInPandas(chained, "chain long, id long, p string, hash string")


def audit_verify(chained: DataFrame) -> DataFrame:
    """Per chain the first id whose hash isn't that of its payload and the hash stored before it; null if all hold."""
    prev = F.coalesce(F.lag("hash").over(Window.partitionBy("chain").orderBy("id")), F.lit(""))
    bad = F.col("hash") != F.upper(F.sha2(F.concat(prev, F.lit("|"), F.col("p")), 256))
    return chained.withColumn("bad", bad).groupBy("chain").agg(F.count("*").alias("events"), F.min(F.when(F.col("bad"), F.col("id"))).alias("first_bad"))


def _left_out(c: str):
    """(name, key): hashes of a name with none, one and two letters left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            rows = []
            for w in b[c]:
                one = {w[:i] + w[i + 1 :] for i in range(len(w))}
                forms = {w} | one | {v[:i] + v[i + 1 :] for v in one for i in range(len(v))}
                rows += [(w, xxhash.xxh64_intdigest(f) >> 1) for f in forms]
            yield pd.DataFrame(rows, columns=[c, "k"])

    return run


def screening(people: DataFrame, entries: DataFrame) -> DataFrame:
    """Best score of each person against each watch-list entry, of which a name (caption, names, aliases) is
    equal, contains all of the person's tokens, is contained or contains, or lies within two letters; ladder:
    equal 1, tokens .85, substring .7, two letters .55, country +.05.  Names under three letters take no part.

    Candidates come from equi joins on distinct names: whole names with up to two letters left
    out (two edits leave one such form equal), and the longest token of either name against all
    pieces of the other (a name contained whole or by its tokens has that one contained)."""
    norm = lambda c: F.translate(F.lower(F.trim(F.regexp_replace(c, r"[\x00-\x1F]", ""))), "ё", "е")
    p = people.select(F.col("id").alias("s"), F.lower("country").alias("pc"), F.explode(F.concat(F.array("fullName"), F.split(F.coalesce("aliases", F.lit("")), r"[;,|]"))).alias("n")).select("s", "pc", norm(F.col("n")).alias("n")).where("length(n) >= 3").distinct()
    e = entries.select(F.col("id").alias("e"), F.lower("country").alias("ec"), F.explode(F.concat(F.array("caption"), F.coalesce("names", F.array()), F.coalesce("aliases", F.array()))).alias("m")).select("e", "ec", norm(F.col("m")).alias("m")).where("length(m) >= 3").distinct()
    names_p, names_e = p.select("n").distinct(), e.select("m").distinct()

    def within(short: DataFrame, long: DataFrame, a: str, b: str) -> DataFrame:
        """Pairs of which the name b contains the longest token of a."""
        key = F.reduce(F.split(a, r"\s+"), F.lit(""), lambda x, t: F.when(F.length(t) > F.length(x), t).otherwise(x))
        s = short.select(a, F.xxhash64(key).alias("k")).hint("merge")  # the exploded side is far larger than its scan
        lengths = F.sequence(F.lit(1), F.length(b))
        pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.length(b)), lambda i: F.transform(lengths, lambda w: F.substring(F.col(b), i, w))))
        return s.join(long.select(b, F.explode(F.array_distinct(F.transform(pieces, lambda t: F.xxhash64(t)))).alias("k")), "k").select("n", "m")

    near = names_p.mapInPandas(_left_out("n"), "n string, k long").hint("merge").join(names_e.mapInPandas(_left_out("m"), "m string, k long"), "k").select("n", "m")
    pair = near.unionByName(within(names_p, names_e, "n", "m")).unionByName(within(names_e, names_p, "m", "n")).distinct()
    has = lambda a, b: F.forall(F.split(a, r"\s+"), lambda t: b.contains(t))
    n, m = F.col("n"), F.col("m")
    score = F.when(n == m, 1.0).when(has(n, m), 0.85).when(n.contains(m) | m.contains(n), 0.70).when(F.levenshtein(n, m, 2) >= 0, 0.55)
    hit = pair.withColumn("score", score).where("score is not null")
    g = hit.join(p, "n").join(e, "m").groupBy("s", "e").agg(F.max("score").alias("b"), F.first("pc").alias("pc"), F.first("ec").alias("ec"))
    return g.select(F.col("s").alias("suspect"), F.col("e").alias("entry"), F.round(F.least(F.lit(1.0), F.col("b") + F.when(F.col("pc") == F.col("ec"), 0.05).otherwise(0.0)), 2).alias("score"))


def totals_by_type(l: DataFrame) -> DataFrame:
    """Income and outgoing of each account with the period they cover."""
    return l.groupBy("acct").agg(total(F.when(is_credit(), F.col("amount"))).alias("income"), total(F.when(~is_credit(), F.col("amount"))).alias("outgoing"), F.datediff(F.max("ts"), F.min("ts")).cast("long").alias("days"))
