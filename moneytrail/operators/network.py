"""Counterparties, transfers, correlations in time and place, links, people, charts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.config import MNT, AmlConfig
from moneytrail.operators.components import connected_components
from moneytrail.operators.ledger import is_credit, micros, night_hour, total

PLACEHOLDER = r"(?iu)^(?:[-–—_.\s]*|n/?a|null|undefined|тодорхойгүй)$"


def cleaned(c: str) -> Column:
    t = F.trim(F.col(c))
    return F.when(~t.rlike(PLACEHOLDER), t)


def norm_name(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def keyed(l: DataFrame) -> DataFrame:
    """Transactions with the identity of their counterparty: name, else national id, else account."""
    n, nat, acc = cleaned("cp_name"), cleaned("cp_nat"), cleaned("cp")
    key = F.coalesce(F.concat(F.lit("name:"), norm_name(n)), F.concat(F.lit("nat:"), F.upper(nat)), F.concat(F.lit("acct:"), acc))
    return l.withColumn("key", key).withColumn("shown", F.coalesce(n, acc, F.lit("—")))


def _money() -> list[Column]:
    return [
        F.count("*").alias("n"), F.count_if(is_credit()).alias("credit_n"), total(F.when(is_credit(), F.col("amount"))).alias("credit"), total(F.when(~is_credit(), F.col("amount"))).alias("debit"),
    ]


def relations(l: DataFrame) -> DataFrame:
    """Per counterparty over all accounts; mutual if two or more accounts deal with it."""
    g = keyed(l).where("key is not null").groupBy("key").agg(*_money(), F.count_distinct("acct").alias("accounts"), F.max_by("shown", F.struct("ts", "id")).alias("name"))
    return g.withColumn("net", F.round(F.col("credit") - F.col("debit"), 2)).withColumn("mutual", F.col("accounts") >= 2)


def relations_by_account(l: DataFrame) -> DataFrame:
    """Totals by account and counterparty, by each alone and overall, in one pass of grouping sets."""
    k = keyed(l).where("key is not null").select("acct", "key", "type", "amount")
    return k.groupingSets([["acct", "key"], ["acct"], []], "acct", "key").agg(F.grouping_id().alias("level"), *_money()).select("level", F.coalesce("acct", F.lit(-1)).alias("acct"), F.coalesce("key", F.lit("")).alias("key"), "n", "credit_n", "credit", "debit")


def account_activity(l: DataFrame) -> DataFrame:
    """Transactions of each account by hour, weekday and month: one pass of grouping sets."""
    x = l.select("acct", "type", "amount", F.hour("ts").alias("hour"), (F.dayofweek("ts") - 1).alias("weekday"), F.date_format("ts", "yyyy-MM").alias("month"))
    g = x.groupingSets([["acct", "hour"], ["acct", "weekday"], ["acct", "month"]], "acct", "hour", "weekday", "month").agg(*_money())
    bucket = F.coalesce(F.concat(F.lit("h"), F.lpad(F.col("hour").cast("string"), 2, "0")), F.concat(F.lit("d"), F.col("weekday").cast("string")), F.concat(F.lit("m"), F.col("month")))
    return g.select("acct", bucket.alias("bucket"), "n", "credit_n", "credit", "debit")


def account_profile(l: DataFrame) -> DataFrame:
    """Night and weekend counts; null and 0 where no row of the account carries a clock."""
    clock = F.bool_or(F.date_format("ts", "HH:mm:ss") != "00:00:00")
    g = l.groupBy("acct").agg(F.count("*").alias("n"), clock.alias("has_clock"), F.count_if(night_hour()).alias("night"), F.count_if(F.dayofweek("ts").isin(1, 7)).alias("weekend"), F.count_distinct(F.date_format("ts", "yyyy-MM")).alias("months"))
    return g.withColumn("night", F.when(F.col("has_clock"), F.col("night")).otherwise(0))


def counterparty_rating(l: DataFrame, cfg: AmlConfig = MNT, top: int = 30) -> DataFrame:
    """Each account's counterparties by count, rated by frequency (ten or more) and size."""
    g = keyed(l).where("key is not null").groupBy("acct", "key").agg(*_money())
    w = Window.partitionBy("acct").orderBy(F.desc("n"), F.desc(F.col("credit") + F.col("debit")), "key")
    big, often = (F.col("credit") + F.col("debit")) >= cfg.high_value, F.col("n") >= 10
    label = F.when(often & big, "FREQUENT_LARGE").when(often, "FREQUENT_SMALL").when(big, "RARE_LARGE").otherwise("RARE_SMALL")
    return g.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top).withColumn("rating", label)


def direct_transfers(l: DataFrame, accounts: DataFrame) -> DataFrame:
    """Transfers between known accounts, by direction and month; a transfer on both statements counts twice."""
    a = accounts.select(F.trim("accountNumber").alias("no"), F.col("id").alias("other")).where("no <> ''").groupBy("no").agg(F.max("other").alias("other"))
    t = l.withColumn("no", F.trim("cp")).join(a, "no").where("acct <> other")
    t = t.select(F.when(is_credit(), F.col("other")).otherwise(F.col("acct")).alias("src"), F.when(is_credit(), F.col("acct")).otherwise(F.col("other")).alias("dst"), F.date_format("ts", "yyyy-MM").alias("month"), "amount")
    return t.groupBy("src", "dst", "month").agg(F.count("*").alias("n"), total().alias("total"))


def network_flow(l: DataFrame, cfg: AmlConfig = MNT, top: int = 30) -> DataFrame:
    """The largest flows between accounts and counterparties, with their colour band."""
    g = l.where("cp is not null and cp <> ''").groupBy("acct", "cp").agg(total().alias("value")).where("value > 0")
    g = g.orderBy(F.desc("value"), "acct", "cp").limit(top).where("cast(acct as string) <> cp")
    v = F.col("value")
    return g.withColumn("band", F.when(v > cfg.reporting, "critical").when(v > cfg.reporting / 2, "high").when(v > cfg.high_value, "medium").otherwise("low"))


def two_sided_ledger(l: DataFrame, accounts: DataFrame) -> DataFrame:
    """Holder rows and, for counterparties that are known accounts of another person, mirrored rows."""
    a = accounts.select(F.col("id").alias("acct"), F.col("suspectId").alias("holder"))
    b = accounts.where("suspectId is not null").select(F.trim("accountNumber").alias("no"), F.col("suspectId").alias("owner")).groupBy("no").agg(F.max("owner").alias("owner"))
    own = l.join(a, "acct", "left")
    mirrored = own.withColumn("no", F.trim("cp")).join(b, "no").where("holder is null or holder <> owner")
    rows = own.where("holder is not null").select(F.col("holder").alias("person"), "type", "amount")
    flip = mirrored.select(F.col("owner").alias("person"), F.when(is_credit(), "debit").otherwise("credit").alias("type"), "amount")
    return rows.unionByName(flip).groupBy("person").agg(F.count("*").alias("n"), total(F.when(is_credit(), F.col("amount"))).alias("incoming"), total(F.when(~is_credit(), F.col("amount"))).alias("outgoing"))


def timeline_correlation(l: DataFrame, calls: DataFrame, accounts: DataFrame, minutes: int = 120, cap: int = 200, top: int = 500) -> DataFrame:
    """Transactions and calls of a suspect on one day within two hours, nearest first: an equi join on
    suspect, day and two-hour slot (calls stand in their own and the two neighbouring slots)."""
    slot = minutes * 60_000_000
    t = l.join(accounts.where("suspectId is not null").select(F.col("id").alias("acct"), F.col("suspectId").alias("s")), "acct").select("s", F.col("id").alias("txn"), micros("ts").alias("tu"), F.to_date("ts").alias("d"))
    t = t.withColumn("slot", F.expr(f"tu div {slot}"))
    c = calls.where("suspectId is not null and startTime is not null").select(F.col("suspectId").alias("s"), F.col("id").alias("call"), micros("startTime").alias("cu"), F.to_date("startTime").alias("d"))
    c = c.withColumn("slot", F.explode(F.expr(f"array(cu div {slot} - 1, cu div {slot}, cu div {slot} + 1)")))
    h = t.join(c, ["s", "d", "slot"]).withColumn("dt", F.abs(F.col("tu") - F.col("cu"))).where(F.col("dt") <= slot)
    w = Window.partitionBy("s").orderBy("dt", "txn", "call")
    h = h.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).orderBy("dt", "txn", "call").limit(top)
    m = F.col("dt") / 6e7
    return h.select(F.col("s").alias("suspect"), "txn", "call", (F.floor(F.col("dt") / 6000) / 10000.0).alias("minutes"), F.when(m <= 15, "CRITICAL").when(m <= 30, "HIGH").when(m <= 60, "MEDIUM").otherwise("LOW").alias("severity"))


# The gazetteer of place names and their coordinates.
GAZETTEER_TEXT = """
БГД 47.9170 106.8550; Баянгол 47.9170 106.8550; Bayangol 47.9170 106.8550; БЗД 47.9100 106.9700;
Баянзүрх 47.9100 106.9700; Bayanzurkh 47.9100 106.9700; СХД 47.9500 106.8900; Сүхбаатар 47.9500 106.8900;
Sukhbaatar 47.9500 106.8900; ХУД 47.8600 106.7500; Хан-Уул 47.8600 106.7500; Khan-Uul 47.8600 106.7500;
ЧД 47.9180 106.9170; Чингэлтэй 47.9180 106.9170; Chingeltei 47.9180 106.9170; СБД 47.9590 107.0100;
Songinokhairkhan 47.9000 106.7000; Сонгинохайрхан 47.9000 106.7000; Налайх 47.7800 107.2570; Nalaikh 47.7800 107.2570;
Багануур 47.8200 108.4200; Baganuur 47.8200 108.4200; Багахангай 47.7800 107.6800; Улаанбаатар 47.9210 106.9180;
Ulaanbaatar 47.9210 106.9180; UB 47.9210 106.9180; Эрдэнэт 49.0344 104.0444; Erdenet 49.0344 104.0444;
Дархан 49.4869 105.9228; Darkhan 49.4869 105.9228; Чойбалсан 48.0719 114.5325; Choibalsan 48.0719 114.5325;
Мөрөн 49.6333 100.1583; Moron 49.6333 100.1583; Ховд 48.0050 91.6419; Khovd 48.0050 91.6419; Улгий 48.9683 89.9617;
Ulgii 48.9683 89.9617; Алтай 46.3742 96.2611; Altai 46.3742 96.2611; Завхан 47.7700 96.3000; Uliastai 47.7400 96.8425;
Сайншанд 44.8956 110.1389; Sainshand 44.8956 110.1389
"""
GAZETTEER = {name.lower(): (float(lat), float(lng)) for name, lat, lng in (p.split() for p in GAZETTEER_TEXT.split(";"))}


def place(c: Column) -> Column:
    """struct(name, lat, lng): the first token of a text that the gazetteer knows, else the whole text; null if neither."""
    m = F.create_map(*[x for k, (a, b) in GAZETTEER.items() for x in (F.lit(k), F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lng")))])
    tokens = F.filter(F.split(c, r"[\s,;./\\—\-]+"), lambda t: F.length(t) >= 2)
    first = F.get(F.filter(tokens, lambda t: F.array_contains(F.lit(sorted(GAZETTEER)), F.lower(t))), F.lit(0))
    name = F.coalesce(first, F.when(F.array_contains(F.lit(sorted(GAZETTEER)), F.lower(F.trim(c))), F.trim(c)))
    at = F.try_element_at(m, F.lower(name))
    return F.when(name.isNotNull(), F.struct(name.alias("name"), at["lat"].alias("lat"), at["lng"].alias("lng")))


def located_events(l: DataFrame, calls: DataFrame) -> DataFrame:
    """Transactions and calls with a location that is neither null nor empty."""
    t = l.select("ts", "location", F.lit("TXN").alias("kind"))
    c = calls.select(F.col("startTime").alias("ts"), "location", F.lit("CALL").alias("kind"))
    return t.unionByName(c).where("location is not null and location <> ''")


def dwell_zones(events: DataFrame, top: int = 10) -> DataFrame:
    """Events by coordinates (four decimals): count, busiest hour, one name, events of each hour; the ten largest."""
    e = events.withColumn("p", place(F.col("location"))).where("p is not null and ts is not null")
    e = e.select(F.round("p.lat", 4).alias("lat"), F.round("p.lng", 4).alias("lng"), F.lower("p.name").alias("name"), F.hour("ts").alias("h"))
    by = e.groupBy("lat", "lng", "h").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    hours = [F.coalesce(F.sum(F.when(F.col("h") == k, F.col("n"))), F.lit(0)).alias(f"h{k:02d}") for k in range(24)]
    g = by.groupBy("lat", "lng").agg(F.sum("n").alias("hits"), F.max_by("h", F.struct("n", -F.col("h"))).cast("long").alias("peak_hour"), F.min("name").alias("name"), *hours)
    return g.orderBy(F.desc("hits"), "lat", "lng").limit(top)


def grid_density(events: DataFrame, km: float = 5.0) -> DataFrame:
    e = events.withColumn("p", place(F.col("location"))).where("p is not null").select(F.col("p.lat").alias("lat"), F.col("p.lng").alias("lng"))
    g = e.groupBy(F.floor(F.col("lat") / (km / 111)).alias("gy"), F.floor(F.col("lng") / (km / 76)).alias("gx"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("lat"), 4).alias("lat"), F.round(F.avg("lng"), 4).alias("lng"))


def suspect_locations(suspects: DataFrame) -> DataFrame:
    p = F.coalesce(place(F.col("address")), place(F.col("city")))
    return suspects.withColumn("p", p).where("p is not null").select("id", F.col("p.name").alias("place"), F.col("p.lat").alias("lat"), F.col("p.lng").alias("lng"))


def travel_correlation(l: DataFrame, calls: DataFrame, accounts: DataFrame, hours: float = 4.0) -> DataFrame:
    """A suspect's transaction and call near in time at different places: equi join on suspect and slot, then the exact span."""
    span = int(max(0.1, hours) * 3.6e9)
    t = l.join(accounts.where("suspectId is not null").select(F.col("id").alias("acct"), F.col("suspectId").alias("s")), "acct").withColumn("p", place(F.col("location"))).where("p is not null")
    t = t.select("s", F.col("id").alias("txn"), micros("ts").alias("tu"), F.col("p.name").alias("txn_place"), F.expr(f"unix_micros(cast(ts as timestamp)) div {span}").alias("slot"))
    c = calls.where("suspectId is not null and startTime is not null").withColumn("p", place(F.col("location"))).where("p is not null")
    c = c.select(F.col("suspectId").alias("s"), F.col("id").alias("call"), micros("startTime").alias("cu"), F.col("p.name").alias("call_place"))
    c = c.withColumn("slot", F.explode(F.expr(f"array(cu div {span} - 1, cu div {span}, cu div {span} + 1)")))
    h = t.join(c, ["s", "slot"]).withColumn("dt", F.col("cu") - F.col("tu")).where((F.abs("dt") <= span) & (F.lower("txn_place") != F.lower("call_place")))
    return h.select(F.col("s").alias("suspect"), "txn", "call", "txn_place", "call_place", (F.floor(F.col("dt") / 6000) / 10000.0).alias("minutes"))


def shared_key_links(people: DataFrame, key: Column) -> DataFrame:
    """(a, b, key) of people with an equal non-empty key, as a star around the least id of each key:
    the links of a group of n need n - 1 rows, not all pairs."""
    k = people.select("id", F.lower(F.trim(key)).alias("key")).where("key <> ''")
    low = k.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("group_size")).where("group_size > 1")
    return k.join(low, "key").where("id <> a").select("a", F.col("id").alias("b"), "key", "group_size")


def financial_links(l: DataFrame, accounts: DataFrame, suspects: DataFrame) -> DataFrame:
    """Links between people by transactions whose counterparty is an account, name or national id of
    another: the disjunction is exploded into keys and joined once."""
    own = accounts.where("suspectId is not null")
    keys = own.select(F.col("suspectId").alias("p"), F.concat(F.lit("a:"), F.trim("accountNumber")).alias("k"))
    keys = keys.unionByName(own.select(F.col("suspectId").alias("p"), F.concat(F.lit("n:"), norm_name(F.col("accountHolderName"))).alias("k")))
    keys = keys.unionByName(suspects.select(F.col("id").alias("p"), F.concat(F.lit("n:"), norm_name(F.col("fullName"))).alias("k")))
    keys = keys.unionByName(suspects.select(F.col("id").alias("p"), F.concat(F.lit("i:"), F.upper(F.trim("nationalId"))).alias("k")))
    keys = keys.where("k is not null and length(k) > 2").distinct()
    t = l.join(own.select(F.col("id").alias("acct"), F.col("suspectId").alias("s")), "acct")
    tk = t.select("s", "id", "amount", "ts", F.explode(F.array(F.concat(F.lit("a:"), F.trim("cp")), F.concat(F.lit("n:"), norm_name(F.col("cp_name"))), F.concat(F.lit("i:"), F.upper(F.trim("cp_nat"))))).alias("k")).where("k is not null and length(k) > 2")
    hit = tk.join(keys, "k").where("s <> p").select(F.least("s", "p").alias("a"), F.greatest("s", "p").alias("b"), "id", "amount", "ts").distinct()
    g = hit.groupBy("a", "b").agg(F.count("*").alias("n"), total().alias("total"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    return g.select("a", "b", "n", "total", F.date_format("t0", "yyyy-MM-dd HH:mm:ss").alias("first_at"), F.date_format("t1", "yyyy-MM-dd HH:mm:ss").alias("last_at"), F.least(F.lit(10), F.col("n")).cast("long").alias("strength"), F.when(F.col("n") > 5, "HIGH").otherwise("MEDIUM").alias("confidence"))


def phone8(c: str) -> Column:
    """Last eight digits, null below six."""
    d = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(d) >= 6, F.right(d, F.lit(8)))


def phone_links(calls: DataFrame, suspects: DataFrame) -> DataFrame:
    """Calls between phones of two people; a phone that several share counts for each of them."""
    p = suspects.select(phone8("primaryPhone").alias("k"), F.col("id").alias("p")).where("k is not null").distinct()
    c = calls.select("id", F.coalesce("durationSeconds", F.lit(0)).alias("sec"), phone8("callerNumber").alias("k1"), phone8("calledNumber").alias("k2"))
    # one row per pair of phones before their owners are looked up
    c = c.where("k1 is not null and k2 is not null and k1 <> k2").groupBy(F.least("k1", "k2").alias("k1"), F.greatest("k1", "k2").alias("k2")).agg(F.count("*").alias("n"), F.sum("sec").alias("sec"))
    h = c.join(p.select(F.col("k").alias("k1"), F.col("p").alias("x")), "k1").join(p.select(F.col("k").alias("k2"), F.col("p").alias("y")), "k2").where("x <> y")
    g = h.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("n").alias("n"), F.sum("sec").alias("seconds"))
    return g.select("a", "b", "n", "seconds", F.least(F.lit(10), F.floor(F.col("n") / 5) + 1).cast("long").alias("strength"), F.when(F.col("n") > 10, "HIGH").otherwise("MEDIUM").alias("confidence"))


def numbered(df: DataFrame, key: str, part: Column, name: str) -> DataFrame:
    """df with its position from 0 in the order of (part, key): numbers inside each part, plus the sizes of
    the parts before it, so that no task holds more than a part.  part must not fall as key grows."""
    d = df.withColumn("_part", part)
    sizes = d.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per part
    w = Window.partitionBy("_part").orderBy(key)
    return d.withColumn("_rn", F.row_number().over(w) - 1).join(before, "_part").withColumn(name, F.col("_before") + F.col("_rn")).drop("_part", "_n", "_before", "_rn")


CHART_PART = 100_000  # ids that one task numbers


def chart_entities(suspects: DataFrame) -> DataFrame:
    """Nodes on a circle around (350, 250) of radius 200, in order of id."""
    w = suspects.where("riskLevel in ('HIGH', 'CRITICAL') and status = 'UNDER_INVESTIGATION'").select("id", "fullName")
    total_ = F.broadcast(w.agg(F.count("*").alias("n")))  # one row
    w = numbered(w, "id", F.expr(f"id div {CHART_PART}"), "i").crossJoin(total_)
    angle = F.col("i") * 2 * 3.141592653589793 / F.col("n")
    return w.select("id", "fullName", F.round(350 + 200 * F.cos(angle), 4).alias("x"), F.round(250 + 200 * F.sin(angle), 4).alias("y"))


def association_matrix(links: DataFrame) -> DataFrame:
    """Symmetric cells of links (a, b, n, total): count, financial sum, strength against the largest values (at least 1)."""
    two = links.select(F.col("a").alias("row"), F.col("b").alias("col"), "n", "total").unionByName(links.select(F.col("b").alias("row"), F.col("a").alias("col"), "n", "total"))
    cell = two.groupBy("row", "col").agg(F.count("*").alias("links"), F.sum("n").alias("events"), F.round(F.sum("total"), 2).alias("value"))
    top = F.broadcast(cell.agg(F.greatest(F.max("events"), F.lit(1)).alias("me"), F.greatest(F.max("value"), F.lit(1.0)).alias("mv")))  # one row
    return cell.crossJoin(top).select("row", "col", "links", "events", "value", F.round(F.least(F.lit(1.0), 0.5 * F.col("value") / F.col("mv") + 0.5 * F.col("events") / F.col("me")), 6).alias("strength"))


def entity_keys(suspects: DataFrame) -> DataFrame:
    """(id, kind, key): names, national ids and phones by which records are one person."""
    parts = [("name", norm_name(F.coalesce("fullName", F.lit("")))), ("id", F.nullif(F.trim("nationalId"), F.lit(""))), ("phone", phone8("primaryPhone"))]
    return reduce(DataFrame.unionByName, [suspects.select("id", F.lit(k).alias("kind"), c.alias("key")).where("key is not null") for k, c in parts])


def entity_components(suspects: DataFrame) -> DataFrame:
    """(id, person): connected components over shared keys (stars around each key's least id); singletons too."""
    k = entity_keys(suspects)
    edges = k.join(k.groupBy("kind", "key").agg(F.min("id").alias("a")), ["kind", "key"]).where("id <> a").select("a", F.col("id").alias("b"))
    c = connected_components(edges)
    return suspects.select("id").join(c, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("person"))


def people(suspects: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row per person: records, highest risk, accounts, phones and first national id."""
    order = F.expr("array_position(array('UNKNOWN','LOW','MEDIUM','HIGH','CRITICAL'), riskLevel)")
    s = suspects.join(entity_components(suspects), "id")
    a = accounts.where("suspectId is not null").groupBy(F.col("suspectId").alias("id")).agg(F.count("*").alias("acc"))
    s = s.join(a, "id", "left")
    g = s.groupBy("person").agg(
        F.count("*").alias("records"), F.max(F.coalesce(order, F.lit(1))).cast("int").alias("r"), F.sum(F.coalesce("acc", F.lit(0))).alias("accounts"), F.count_distinct(phone8("primaryPhone")).alias("phones"), F.count_distinct("caseId").alias("cases"),
        F.min_by("nationalId", F.when(F.col("nationalId").isNotNull(), F.col("id"))).alias("national_id"),
    )
    return g.select("person", "records", F.expr("element_at(array('UNKNOWN','LOW','MEDIUM','HIGH','CRITICAL'), r)").alias("risk"), "accounts", "phones", "cases", "national_id")
