"""All queries of the core, over whole tables, and their SQL (in plans.oracle)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moneytrail.config import MNT
from moneytrail.functions import scalars as sc
from moneytrail.operators import casework as cw
from moneytrail.operators import imports as im
from moneytrail.operators import ledger as lg
from moneytrail.operators import network as nw
from moneytrail.operators import reports as rp
from moneytrail.operators import rules as rl
from moneytrail.operators.normalise_times import p3_estimated, p3_found
from moneytrail.operators.parse_failures import p5_found, p5_rows
from moneytrail.operators.schema_drift import p2_found, p2_unified, unified
from moneytrail.plans.oracle import ORACLE_SQL  # noqa: F401
from moneytrail.plans.session import table
from moneytrail.sources.sinks import export_sheets
from moneytrail.streaming.windows import daily_flows

BURST_WIDE = replace(MNT, burst_minutes=7 * 24 * 60.0)  # no number calls five times within half an hour here

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_unified, p3_found, p3_estimated, p5_found, p5_rows)}


class Tables:
    """The tables of a directory, read when used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._at = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        spark, sf_dir = self._at
        if name == "ledger":
            return lg.ledger(spark, sf_dir)
        return table(spark, sf_dir, name)


def query(name: str) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        return f

    return add


for _f in (
    lg.account_statistics, lg.hourly_distribution, lg.weekday_distribution, lg.top_recipients, lg.category_breakdown, lg.channel_breakdown,
    lg.monthly_trend, lg.benford_test, lg.benford_observed, lg.account_analysis, rl.rule_scores, rl.rule_features, rl.pattern_rapid,
    rl.pattern_round_trip, rl.pattern_smurfing, rl.drill_down, nw.relations, nw.relations_by_account, nw.account_activity, nw.account_profile,
    nw.counterparty_rating, nw.network_flow, cw.totals_by_type,
):
    query(_f.__name__)(lambda t, f=_f: f(t.ledger))
for _name, _f in rl.RULES.items():
    query(_name)(lambda t, f=_f: f(t.ledger))

query("pattern_burst")(lambda t: rl.pattern_burst(t.call_records, BURST_WIDE))
query("top_alerts")(lambda t: rl.top_alerts(t.ledger, t.call_records))
query("direct_transfers")(lambda t: nw.direct_transfers(t.ledger, t.bank_accounts))
query("two_sided_ledger")(lambda t: nw.two_sided_ledger(t.ledger, t.bank_accounts))
query("timeline_correlation")(lambda t: nw.timeline_correlation(t.ledger, t.call_records, t.bank_accounts))
query("travel_correlation")(lambda t: nw.travel_correlation(t.ledger, t.call_records, t.bank_accounts))
query("dwell_zones")(lambda t: nw.dwell_zones(nw.located_events(t.ledger, t.call_records)))
query("grid_density")(lambda t: nw.grid_density(nw.located_events(t.ledger, t.call_records)))
query("located_events")(lambda t: nw.located_events(t.ledger, t.call_records).groupBy("kind", "location").agg(F.count("*").alias("n")))
query("suspect_locations")(lambda t: nw.suspect_locations(t.suspects))
query("links_financial")(lambda t: nw.financial_links(t.ledger, t.bank_accounts, t.suspects))
query("links_shared_address")(lambda t: nw.shared_key_links(t.suspects, F.col("address")))
query("links_shared_phone")(lambda t: nw.shared_key_links(t.suspects, nw.phone8("primaryPhone")))
query("links_phone")(lambda t: nw.phone_links(t.call_records, t.suspects))
query("association_matrix")(lambda t: nw.association_matrix(nw.financial_links(t.ledger, t.bank_accounts, t.suspects)))
query("chart_entities")(lambda t: nw.chart_entities(t.suspects))
query("entity_components")(lambda t: nw.entity_components(t.suspects))
query("people")(lambda t: nw.people(t.suspects, t.bank_accounts))
query("dashboard")(lambda t: cw.dashboard(t.ledger, t.suspects, t.call_records, t.bank_accounts))
query("record_stats")(lambda t: cw.record_stats(t.ledger, t.bank_accounts, t.suspects))
query("suspect_holdings")(lambda t: cw.suspect_holdings(t.suspects, t.bank_accounts))
query("screening")(lambda t: cw.screening(t.suspects, t.sanctions_entries))
query("reference_dedup")(lambda t: cw.reference_dedup(t.ledger).groupBy("acct").agg(F.count("*").alias("n"), F.sum("id").alias("ids")))
query("access_dedup")(lambda t: cw.access_dedup(t.events.select(F.col("event_id").alias("id"), F.to_date("ts").alias("ts"), F.col("user_id").alias("user"), F.col("event_type").alias("address"))).select("id", "user", "address", "copies"))
query("scan_distinct_callers")(lambda t: t.call_records.where("callerNumber is not null").select("callerNumber").distinct())
query("scan_page")(lambda t: cw.paged(t.ledger.where("acct = 1"), 3, 50).select("id", "acct", "amt"))
query("scan_neighbours")(lambda t: cw.neighbours(t.ledger, 1, "2024-01-01 00:00:00", 60 * 24 * 14).select("id", "amt"))
query("scan_suspect_calls")(lambda t: t.call_records.join(t.suspects.where("riskLevel = 'CRITICAL'").select(F.col("id").alias("suspectId")), "suspectId", "left_semi").groupBy("suspectId").agg(F.count("*").alias("n")))


@query("noise_filter")
def _noise(t: Tables) -> DataFrame:
    pairs = t.ledger.where("flagStatus = 'REVIEW'").select("acct", "cp").where("cp is not null").distinct()
    kept = cw.noise_filter(t.ledger, 5000, [("starts", "ATM"), ("includes", "төлбөр")], pairs)
    return kept.groupBy("acct").agg(F.count("*").alias("n"), lg.total().alias("total"))


@query("case_scope")
def _scope(t: Tables) -> DataFrame:
    return cw.case_scope(t.ledger, t.suspects, t.bank_accounts, ["CASE-1", "CASE-7", "CASE-48"]).groupBy("acct").agg(F.count("*").alias("n"), lg.total().alias("total"))


@query("purge_plan")
def _purge(t: Tables) -> DataFrame:
    return cw.purge_plan(t.ledger, t.suspects, t.bank_accounts, "CASE-7")


@query("bag_dedup")
def _bag(t: Tables) -> DataFrame:
    """The second half of the years against the first, on amount, type, account and day of month."""
    l = t.ledger.withColumn("day", F.dayofmonth("ts").cast("long")).withColumn("whole", F.floor(F.col("amt") / 1000).cast("long"))
    new, old = l.where(F.year("ts") >= 2024), l.where(F.year("ts") < 2024)
    return cw.bag_except(new, old, ["acct", "type", "day", "whole"]).groupBy("acct").agg(F.count("*").alias("n"))


@query("merge_renumber")
def _merge(t: Tables) -> DataFrame:
    e = t.suspects.where("caseId is not null").select(F.col("caseId"), F.col("id").alias("exhibit"), F.col("id"))
    return cw.merge_renumber(e, "CASE-7")


@query("delete_account")
def _delete(t: Tables) -> DataFrame:
    links = t.ledger.where("cp is not null").groupBy(F.col("cp").alias("id")).agg(F.collect_list("id").alias("txns"))
    return cw.delete_account(t.ledger, links, 1)[1].select("id", F.size("txns").cast("long").alias("n"))


@query("audit_verify")
def _audit(t: Tables) -> DataFrame:
    """A chain per account over all its transactions, one entry of every tenth chain altered afterwards."""
    e = t.ledger.select(F.col("acct").alias("chain"), "id", lg.stamp("ts").alias("at"), F.col("channel").alias("actor"), F.col("flagStatus").alias("action"), F.col("cp").alias("target"), F.col("description").alias("detail"))
    c = cw.audit_chain(e)
    return cw.audit_verify(c.withColumn("p", F.when(F.col("chain") % 10 == 0, F.concat("p", F.lit("!"))).otherwise(F.col("p"))))


@query("entity_counts")
def _counts(t: Tables) -> DataFrame:
    a = t.ledger.groupBy(F.col("acct").alias("id")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("account"))
    c = t.call_records.where("suspectId is not null").groupBy(F.col("suspectId").alias("id")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("suspect"))
    return a.unionByName(c)


@query("fraud_workflow")
def _workflow(t: Tables) -> DataFrame:
    """Analysis, rules and digit test of every account in one job."""
    a = lg.account_analysis(t.ledger).select("acct", "n", "overall", F.col("risk").alias("analysis_risk"), "verdict")
    r = rl.rule_scores(t.ledger).select("acct", "final_score", "action", "risk")
    b = lg.benford_test(t.ledger).select("acct", "chi_square", "passes")
    names = t.bank_accounts.select(F.col("id").alias("acct"), F.concat_ws(" - ", F.coalesce("bankName", F.lit("Банк")), "accountNumber").alias("name"))
    return a.join(r, "acct").join(b, "acct", "left").join(names, "acct", "left")


@query("scalar_functions")
def _scalars(t: Tables) -> DataFrame:
    return t.ledger.select(
        "id", lg.leading_digit().cast("long").alias("digit"), F.hour("ts").cast("long").alias("hour"), (F.dayofweek("ts") - 1).cast("long").alias("weekday"), F.weekofyear("ts").cast("long").alias("week"),
        F.expr("extract(yearofweek from ts)").cast("long").alias("week_year"), sc.money(F.col("amount")).alias("money"), nw.norm_name(F.col("cp_name")).alias("name"), lg.near_threshold().alias("near"),
        lg.round_number().alias("is_round"), lg.off_hours().alias("off"), lg.night_hour().alias("night"), lg.weekend().alias("weekend"), F.when(lg.is_credit(), F.col("amt")).otherwise(-F.col("amt")).alias("signed"),
        F.upper(F.sha2(F.coalesce("description", F.lit("")), 256)).alias("sha"), nw.cleaned("cp_name").alias("cleaned"),
    )


@query("import_summary")
def _import(t: Tables) -> DataFrame:
    """Bank files, their profile stated or found: lines imported, skipped and duplicate, those that don't parse among the skipped."""
    return im.summary(im.import_bank(_lines_of(t, "BANK")))


@query("import_file_calls")
def _import_file_calls(t: Tables) -> DataFrame:
    return im.import_calls(_lines_of(t, "CDR"), as_of_us=1_767_225_600_000_000)


@query("import_file_access")
def _import_file_access(t: Tables) -> DataFrame:
    return im.import_access(_lines_of(t, "ACCESS_LOG"))


def _lines_of(t: Tables, domain: str) -> DataFrame:
    kinds = F.broadcast(t.import_profiles.where(F.col("domain") == domain).select(F.col("profileId").alias("profile")))  # a configuration table
    return unified(t.import_files, t.import_profiles, valid=False).join(kinds, "profile", "left_semi")


def _cells(**cells) -> F.Column:
    """A row's map of field to text."""
    return F.create_map(*[x for k, c in cells.items() for x in (F.lit(k), c.cast("string"))]).alias("data")


@query("import_ledger")
def _import_ledger(t: Tables) -> DataFrame:
    """The ledger typed as statement lines (signed amounts with grouping) and imported again: status by account."""
    signed = F.when(lg.is_credit(), F.col("amount")).otherwise(-F.col("amount"))
    lines = t.ledger.select(
        F.lit(0).cast("long").alias("fileid"), F.col("id").alias("lineno"),
        _cells(date=lg.stamp("ts"), amount=F.format_number(signed, 2), account=F.col("acct"), description=F.col("description"), reference=F.col("ref"), balanceBefore=F.lit("1000")),
    )
    got = im.import_bank(lines).where("ts_us is not null")
    return got.groupBy(F.col("account").cast("long").alias("acct"), "status", "type").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"), F.round(F.sum("balance"), 2).alias("balances"))


@query("import_calls")
def _import_calls(t: Tables) -> DataFrame:
    """The calls typed as lines of a bill: wrapped numbers, minutes, every fifth with a frequency of two."""
    c = t.call_records.where("startTime is not null")
    lines = c.select(
        F.lit(0).cast("long").alias("fileid"), F.col("id").alias("lineno"),
        _cells(caller=F.concat(F.lit("line <"), "callerNumber", F.lit(">")), called=F.col("calledNumber"), datetime=lg.stamp("startTime"), duration=F.col("durationSeconds") / 60, frequency=F.when(F.col("id") % 5 == 0, "2 times")),
    )
    got = im.import_calls(lines, as_of_us=1_767_225_600_000_000)
    return got.groupBy("caller", "direction").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"), F.min("ts_us").alias("first_us"))


@query("import_access")
def _import_access(t: Tables) -> DataFrame:
    """The events typed as lines of an access log, to the day."""
    lines = t.events.select(F.lit(0).cast("long").alias("fileid"), F.col("event_id").alias("lineno"), _cells(timestamp=F.date_format("ts", "yyyy-MM-dd"), accountId=F.col("user_id"), ip=F.col("event_type")))
    return im.import_access(lines).select("lineno", F.col("user").cast("long").alias("user"), "ip", "ts_us")


query("export_transactions")(
    lambda t: export_sheets(t.ledger, t.suspects, t.bank_accounts, t.call_records, t.suspects.limit(0))["Transactions"].groupBy("account", "owner").agg(F.count("*").alias("n"), lg.total().alias("total"))
)
query("stream_daily_flows")(lambda t: daily_flows(t.ledger).select("acct", F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("inflow", F.lit(0.0)).alias("inflow"), F.coalesce("outflow", F.lit(0.0)).alias("outflow"), "n", "mule"))

CASES = ["CASE-1", "CASE-7", "CASE-48"]


def _evidence(t: Tables) -> DataFrame:
    """Entries from what the tables hold: suspicious transactions of owned accounts, and accounts, under their owners' cases."""
    own = t.bank_accounts.join(t.suspects.where("caseId is not null").select(F.col("id").alias("suspectId"), "caseId"), "suspectId").select("caseId", "id")
    txn = t.ledger.where("flagStatus = 'SUSPICIOUS'").join(own.select("caseId", F.col("id").alias("acct")), "acct").select("caseId", F.lit("TXN").alias("sourceType"), F.col("id").alias("sourceId"))
    acc = own.select("caseId", F.lit("ACCOUNT").alias("sourceType"), F.col("id").alias("sourceId"))
    return txn.unionByName(acc).withColumn("exhibit", F.col("sourceId"))


query("scan_lookup")(lambda t: rp.lookup(t.bank_accounts, 1).select("id", "accountNumber", "bankName"))
query("scan_page_total")(lambda t: rp.paged_with_total(t.ledger.where("acct = 1"), 2, 25).select("id", "acct", "amt", "total_count"))
query("locations_since")(lambda t: rp.locations_since(t.ledger, "2022-06-01 00:00:00").groupBy("location").agg(F.count("*").alias("n")))
query("audit_search")(lambda t: rp.audit_search(t.ledger.select("id", lg.stamp("ts").alias("at"), F.coalesce("channel", F.lit("")).alias("actor"), F.coalesce("flagStatus", F.lit("")).alias("action")), start="2021-01-01", actor="a", action="susp", take=500))
query("person_columns")(lambda t: rp.person_columns(t.suspects, "2026-01-01", F.when(F.col("dateOfBirth").rlike(r"^\d{4}-\d{2}-\d{2}"), F.left("dateOfBirth", F.lit(10)).try_cast("date"))))
query("evidence_scope")(lambda t: rp.evidence_scope(t.ledger, t.suspects, t.bank_accounts, _evidence(t), CASES).groupBy("acct").agg(F.count("*").alias("n")))
query("links_in_scope")(lambda t: rp.links_in_scope(nw.financial_links(t.ledger, t.bank_accounts, t.suspects), t.suspects.where("riskLevel in ('HIGH', 'CRITICAL', 'MEDIUM')").select("id")).select("a", "b", "n"))
query("scoped_dashboard")(lambda t: rp.scoped_dashboard(t.ledger, t.suspects, t.call_records, t.bank_accounts, CASES))
query("evidence_first")(lambda t: rp.first_evidence_per_case(_evidence(t), t.suspects.where("caseId is not null").groupBy("caseId").agg(F.concat(F.lit("Case of "), F.count("*").cast("string")).alias("title"))))
query("calls_of_suspects")(lambda t: rp.calls_of(t.suspects, t.call_records))
query("qualified_transfers")(lambda t: rp.qualified_transfers(t.ledger, t.bank_accounts, t.suspects, 1_000_000).select("id", "acct", "amt"))
query("flow_ranking")(lambda t: rp.flow_ranking(nw.relations(t.ledger)))
query("verdict_period")(lambda t: rp.period(t.ledger))
query("owner_ordered")(lambda t: rp.owner_ordered(cw.record_stats(t.ledger, t.bank_accounts, t.suspects).select("acct", "owner", "n"), 200))
query("relations_ordered")(lambda t: nw.relations(t.ledger).orderBy(F.desc("n"), F.desc(F.col("credit") + F.col("debit")), "key").limit(60).select("key", "n"))
query("transfers_ordered")(lambda t: nw.direct_transfers(t.ledger, t.bank_accounts).groupBy("src", "dst").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total")).orderBy(F.desc("total"), "src", "dst").limit(60))
query("people_ordered")(lambda t: nw.people(t.suspects, t.bank_accounts).orderBy(F.desc("cases"), F.desc("records"), "person").limit(100).select("person", "cases", "records"))
query("screening_ordered")(lambda t: cw.screening(t.suspects, t.sanctions_entries).orderBy(F.desc("score"), "suspect", "entry").limit(50))
query("links_replaced")(lambda t: rp.replaced_links(_stored_links(t).unionByName(_stored_links(t).withColumn("kind", F.lit("MANUAL"))), _new_links(t), ["FINANCIAL"]).groupBy("kind").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")))
query("evidence_tagged")(lambda t: rp.tagged(_evidence(t).where("sourceType = 'ACCOUNT'"), _evidence(t)).groupBy("caseId").agg(F.count("*").alias("n"), F.max("exhibit").alias("last")))
query("delete_case")(lambda t: _sizes(rp.delete_case(t.ledger, t.suspects, t.bank_accounts, t.call_records, "CASE-7")))
query("flow_nodes")(lambda t: rp.flow_nodes(nw.network_flow(t.ledger), t.bank_accounts, t.suspects))
query("drill_down_rows")(lambda t: rp.drill_down_rows(t.ledger))
query("strongest_links")(lambda t: rp.strongest_links(rp.typed_links({"FINANCIAL": nw.financial_links(t.ledger, t.bank_accounts, t.suspects), "COMMUNICATION": nw.phone_links(t.call_records, t.suspects)})))


def _stored_links(t: Tables) -> DataFrame:
    return nw.shared_key_links(t.suspects, F.col("address")).select(F.lit("FINANCIAL").alias("kind"), "a", "b")


def _new_links(t: Tables) -> DataFrame:
    return nw.financial_links(t.ledger, t.bank_accounts, t.suspects).select(F.lit("FINANCIAL").alias("kind"), "a", "b")


def _sizes(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, d in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
