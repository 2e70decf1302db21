"""The same queries in SQL, for the comparison of results."""

from moneytrail.operators.network import GAZETTEER

L = """l as (select id, bankAccountId as acct, "timestamp" as ts, amount, cast(amount as double) as amt, lower(coalesce(type, 'debit')) as type,
  category, description, referenceNumber as ref, counterpartyAccount as cp, counterpartyName as cp_name, counterpartyNationalId as cp_nat,
  channel, location, currency, flagStatus from bank_transactions where bankAccountId is not null and "timestamp" is not null and amount is not null)"""
C, D = "sum(case when type = 'credit' then amount end)", "sum(case when type <> 'credit' then amount end)"
MONEY = f"count(*) as n, count(*) filter (type = 'credit') as credit_n, coalesce({C}, 0)::double as credit, coalesce({D}, 0)::double as debit"
AT = "strftime({}, '%Y-%m-%d %H:%M:%S')"
CL = "case when not regexp_full_match(trim({0}), '(?i)(?:[-–—_.\\s]*|n/?a|null|undefined|тодорхойгүй)') then trim({0}) end"
NORM = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
KEYED = f"""k as (select *, coalesce('name:' || {NORM.format(CL.format('cp_name'))}, 'nat:' || upper({CL.format('cp_nat')}), 'acct:' || {CL.format('cp')}) as key,
  coalesce({CL.format('cp_name')}, {CL.format('cp')}, '—') as shown from l)"""
B = [30.1, 17.6, 12.5, 9.7, 7.9, 6.7, 5.8, 5.1, 4.6]
DIGIT = "case when abs(amount) >= 1 then cast(left(cast(abs(amount) as varchar), 1) as int) else 0 end"
DIG = f"b as (select acct, count(*) as n, {', '.join(f'count(*) filter (d = {k}) as d{k}' for k in range(1, 10))} from (select acct, {DIGIT} as d from l) where d between 1 and 9 group by acct)"
CHI = " + ".join(f"power(d{k} - n * {e / 100!r}::double, 2) / (n * {e / 100!r}::double)" for k, e in enumerate(B, 1))
BEN = f"t as (select acct, n, chi, exp(-chi/2) * (1 + chi/2 + power(chi/2, 2)/2 + power(chi/2, 3)/6) as p from (select *, {CHI} as chi from b))"
NEAR, ROUND, OFF = "amount >= 17000000 and amount < 20000000", "amount >= 50000 and amount % 10000 = 0", "hour(ts) >= 0 and hour(ts) < 6"
US = "epoch_us(ts)"


def _rule(rule: int, severity: str, score: float, what: str, at: str, source: str) -> str:
    return f"select acct, {rule}::bigint as rule, '{severity}' as severity, {score}::double as score, cast({what} as varchar) as what, {at} as at from {source}"


DAYTS = "strftime(d, '%Y-%m-%d 00:00:00')"
CLUST = """(select *, row_number() over (partition by acct order by o_ts, o_id) as rn from (
   select acct, cp, isoyear(ts) as y, week(ts) as w, count(*) as n, max(amount) as top, sum(amount) as s, min(ts) as o_ts, arg_min(id, (ts, id)) as o_id
   from l where cp is not null and cp <> '' group by all having count(*) >= 3 and max(amount) < 20000000 and sum(amount) >= 20000000) qualify rn <= 5)"""
SMURF = """(select acct, cast(ts as date) as d, count(distinct nullif(cp, '')) as sources, sum(amount) as s, min(ts) as t0, max(ts) as t1 from l
   where type = 'credit' and amount < 3000000 group by all having count(distinct nullif(cp, '')) >= 3 and sum(amount) > 9000000)"""
RULES = {
    "rule_velocity": _rule(1, "HIGH", 0.3, "k", AT.format("ts"), f"""(select *, row_number() over (partition by acct order by ts, id) as rn from (
        select acct, ts, id, coalesce(lead(ts, 5) over w, lead(ts, 4) over w) as e, case when lead(ts, 5) over w is not null then 6 else 5 end as k from l window w as (partition by acct order by ts, id))
        where e is not null and (epoch_us(e) - {US}) / 6e7 < 10 qualify rn = 1)"""),
    "rule_anomaly": _rule(2, "HIGH", 0.2, "id", AT.format("ts"), """(select *, row_number() over (partition by acct order by ts, id) as rn from (
        select *, avg(amt) over (partition by acct) as m, stddev_samp(amt) over (partition by acct) as sd from l) where sd > 0 and (amt - m) / sd > 3 qualify rn <= 5)"""),
    "rule_structuring": _rule(3, "CRITICAL", 0.4, "cp", AT.format("o_ts"), CLUST),
    "rule_approaching": _rule(4, "MEDIUM", 0.1, "id", AT.format("ts"), f"""(select *, row_number() over (partition by acct order by ts, id) as rn from l
        where {NEAR} and cp is not null and cp <> '' and not exists (select 1 from {CLUST} c where c.acct = l.acct and c.cp = l.cp) qualify rn <= 3)"""),
    "rule_round_amounts": _rule(5, "MEDIUM", 0.15, "n", "null::varchar", f"""(select acct, count(*) filter ({ROUND}) as n from
        (select *, row_number() over (partition by acct order by ts desc, id desc) as rn from l qualify rn <= 10) group by acct having count(*) filter ({ROUND}) >= 5)"""),
    "rule_surge": _rule(6, "HIGH", 0.25, "n", DAYTS, """(select *, row_number() over (partition by acct order by d) as rn from (
        select acct, cast(ts as date) as d, count(distinct cp) as n from l where cp is not null and cp <> '' group by all having count(distinct cp) > 10) qualify rn <= 3)"""),
    "rule_night": _rule(7, "MEDIUM", 0.15, "n", AT.format("t"), f"(select acct, count(*) as n, min(ts) as t from l where {OFF} and amount > 1000000 group by acct)"),
    "rule_mule": _rule(10, "CRITICAL", 0.4, "cast(trunc(c::double) as bigint)", DAYTS, f"""(select *, row_number() over (partition by acct order by d) as rn from (
        select acct, cast(ts as date) as d, {C} as c, {D} as o from l group by all) where c > 10000000 and o::double > c::double * 0.9::double qualify rn = 1)"""),
    "rule_smurfing": _rule(11, "CRITICAL", 0.35, "sources", AT.format("t0"), f"(select *, row_number() over (partition by acct order by d) as rn from {SMURF} qualify rn = 1)"),
    "rule_round_trip": _rule(12, "HIGH", 0.2, "id", AT.format("ts"), """(with r as (select *, row_number() over (partition by acct order by ts, id) as n from l)
        select a.acct, a.id, a.ts, row_number() over (partition by a.acct order by a.n, b.n) as rn from r a join r b on a.acct = b.acct and b.n between a.n + 1 and a.n + 9
        where a.n <= 200 and (a.type = 'credit') <> (b.type = 'credit') and abs(b.amt - a.amt) < a.amt * 0.05::double qualify rn = 1)"""),
}
V = "v as (" + " union all ".join(f"select * from ({q})" for q in RULES.values()) + ")"


def _alert(kind: str, severity: str, who: str, at: str, what: str, source: str) -> str:
    return f"select '{kind}' as kind, '{severity}' as severity, cast({who} as varchar) as subject, {AT.format(at)} as at, cast({what} as varchar) as what from {source}"


RAPID = _alert("RAPID", "HIGH", "acct", "ts", "id", f"""(select *, row_number() over (partition by acct order by ts, id) as rn from (
    select *, ({US} - lag({US}) over (partition by acct order by ts, id)) / 6e7 as gap from l) where gap < 5 and amount > 1000000 qualify rn <= 3)""")
TRIP = _alert("ROUND_TRIP", "HIGH", "acct", "ts", "m", """(with r as (select *, row_number() over (partition by acct order by ts, id) as n from l),
    h as (select b.acct, b.ts, b.id, arg_max(a.id, a.n) as m from r b join r a on a.acct = b.acct and a.n between b.n - 10 and b.n - 1
          where (a.type = 'credit') <> (b.type = 'credit') and abs(a.amt - b.amt) < a.amt * 0.05::double group by all)
    select *, row_number() over (partition by acct order by ts, id) as rn from h qualify rn <= 3)""")
SMURFP = _alert("SMURFING", "CRITICAL", "acct", "t1", "sources", SMURF)
FIN = f"""own as (select * from bank_accounts where suspectId is not null),
  keys as (select distinct p, k from (select suspectId as p, 'a:' || trim(accountNumber) as k from own union all select suspectId, 'n:' || {NORM.format('accountHolderName')} from own
     union all select id, 'n:' || {NORM.format('fullName')} from suspects union all select id, 'i:' || upper(trim(nationalId)) from suspects) where k is not null and length(k) > 2),
  t as (select o.suspectId as s, l.* from l join own o on o.id = l.acct),
  tk as (select s, id, amount, ts, 'a:' || trim(cp) as k from t union all select s, id, amount, ts, 'n:' || {NORM.format('cp_name')} from t union all select s, id, amount, ts, 'i:' || upper(trim(cp_nat)) from t),
  hit as (select distinct least(s, p) as a, greatest(s, p) as b, id, amount, ts from tk join keys using (k) where s <> p and length(k) > 2),
  fin as (select a, b, count(*) as n, sum(amount)::double as total, {AT.format('min(ts)')} as first_at, {AT.format('max(ts)')} as last_at, least(10, count(*))::bigint as strength,
     case when count(*) > 5 then 'HIGH' else 'MEDIUM' end as confidence from hit group by a, b)"""


def phone8(c: str) -> str:
    d = f"regexp_replace({c}, '[^0-9]', '', 'g')"
    return f"case when length({d}) >= 6 then right({d}, 8) end"


def shared(key: str) -> str:
    return f"""with k as (select id, lower(trim({key})) as key from suspects), g as (select key, min(id) as a, count(*) as group_size from k where key <> '' group by key having count(*) > 1)
      select a, id as b, key, group_size from k join g using (key) where id <> a"""


DEDUP = "(select * from l where ref is null union all select * exclude (rn) from (select *, row_number() over (partition by acct, ref order by id) as rn from l where ref is not null) where rn = 1)"

ORACLE_SQL = {
    "account_statistics": f"""with {L}, h as (select acct, b, count(*) as n from (select acct, hour(ts) as b from l) group by all), d as (select acct, b, count(*) as n from (select acct, dayofweek(ts) as b from l) group by all),
      s as (select acct, count(*) as n, sum(amount)::double as total, round(median(amt), 4) as median, max(amt) as max_amount, min(amt) as min_amount, round(coalesce(stddev_samp(amt), 0), 2) as std_dev,
        coalesce({C}, 0)::double as credits, coalesce({D}, 0)::double as debits, count(*) filter (type = 'credit') as credit_count, count(*) filter (type <> 'credit') as debit_count from l group by acct)
      select s.*, total / n as average, case when credits > 0 then round(debits / credits, 6) else 0.0 end::double as debit_credit_ratio, round(credits - debits, 2) as net_flow, peak_hour, peak_day
      from s join (select acct, arg_max(b, (n, -b))::bigint as peak_hour from h group by acct) using (acct) join (select acct, arg_max(b, (n, -b))::bigint as peak_day from d group by acct) using (acct)""",
    "hourly_distribution": f"with {L} select r.range as hour, count(l.id) as n from range(24) r left join l on hour(l.ts) = r.range group by 1",
    "weekday_distribution": f"with {L} select r.range as weekday, count(l.id) as n from range(7) r left join l on dayofweek(l.ts) = r.range group by 1",
    "top_recipients": f"""with {L} select *, row_number() over (partition by acct order by total desc, cp) as rank from (select acct, cp, sum(amount)::double as total, count(*) as n, arg_min(coalesce(cp_name, cp), (ts, id)) as name
      from l where cp is not null and cp <> '' group by all) qualify rank <= 10""",
    "category_breakdown": f"with {L} select coalesce(category, 'Other') as category, count(*) as n, sum(amount)::double as total from l group by 1",
    "channel_breakdown": f"with {L} select coalesce(channel, 'Unknown') as channel, count(*) as n, sum(amount)::double as total from l group by 1",
    "monthly_trend": f"with {L} select acct, strftime(ts, '%Y-%m') as month, coalesce({C}, 0)::double as credits, coalesce({D}, 0)::double as debits, count(*) as n from l group by 1, 2",
    "benford_test": f"with {L}, {DIG}, {BEN} select acct, n, case when n < 10 then 0 else round(chi, 6) end::double as chi_square, case when n < 10 then 1 else round(p, 6) end::double as p_value, n < 10 or p > 0.05 as passes from t",
    "benford_observed": f"with {L}, {DIG} " + " union all ".join(f"select acct, {k}::bigint as digit, round(d{k} * 100.0::double / n, 6) as observed from b" for k in range(1, 10)),
    "account_analysis": f"""with {L}, {DIG}, {BEN}, day as (select acct, max(n) as max_per_day from (select acct, cast(ts as date) as d, count(*) as n from l group by all) group by acct),
      wk as (select acct, coalesce(stddev_samp(n), 0) as weekly_std from (select acct, week(ts) as w, count(*) as n from l group by all) group by acct),
      a as (select acct, count(*) as n, sum(amount)::double as total, coalesce(stddev_samp(amt), 0) as sd, (max({US}) - min({US})) / 8.64e10::double as days, count(*) filter ({ROUND}) * 100.0::double / count(*) as round_pct,
        count(*) filter ({OFF}) * 100.0::double / count(*) as off_pct, count(*) filter ({NEAR}) * 100.0::double / count(*) as near_pct, count(*) filter (dayofweek(ts) in (0, 6)) as weekend_n, count(distinct category) + max(case when category is null then 1 else 0 end) as categories from l group by acct),
      s as (select *, case when days > 0 then n / days else n end::double as per_day, case when total > 0 then least(100, sd / (total / n) * 100) else 0 end as variance from a),
      o as (select *, least(100, per_day * 10) as velocity, (least(100, per_day * 10) + variance + round_pct + least(100, off_pct * 2) + least(100, near_pct * 5) + least(100, categories * 10.0::double)) / 6 as overall from s),
      f as (select o.*, max_per_day, weekly_std, concat_ws('; ', case when not coalesce(t.n < 10 or t.p > 0.05, true) then 'Benford''s Law deviation' end, case when near_pct > 10 then 'Potential structuring' end, case when round_pct > 30 then 'Excessive round amounts' end,
        case when off_pct > 40 then 'High off-hours activity' end, case when per_day > 5 then 'High velocity' end) as flags from o join day using (acct) join wk using (acct) left join t using (acct))
      select acct, n, round(per_day, 6) as avg_per_day, max_per_day, round(weekly_std, 6) as weekly_std, round(velocity, 4)::double as velocity_score, round(variance, 3)::double as variance_score, round(round_pct, 4) as round_pct, round(off_pct, 4) as off_pct,
        round(near_pct, 4) as near_pct, weekend_n, categories::bigint as categories, round(overall, 3)::double as overall, case when overall >= 60 then 'HIGH' when overall >= 35 then 'MEDIUM' else 'LOW' end as risk,
        case when flags = '' then 'No significant anomalies detected' else flags end as verdict from f""",
    **{k: f"with {L} {q}" for k, q in RULES.items()},
    "rule_scores": f"""with {L}, {V}, g as (select acct, sum(score::decimal(4,2)) as s, count(*) filter (severity = 'CRITICAL') as critical, count(*) filter (severity = 'HIGH') as high, count(*) as violations from v group by acct),
      a as (select acct, coalesce(violations, 0) as violations, coalesce(critical, 0) as critical, coalesce(high, 0) as high, least(1, coalesce(s, 0))::double as base_score from (select distinct acct from l) left join g using (acct)),
      f as (select *, round(least(1, base_score + critical * 0.1 + high * 0.05), 2)::double as final_score from a)
      select *, case when final_score >= 0.75 then 'BLOCK' when final_score >= 0.5 then 'HOLD FOR REVIEW' when final_score >= 0.3 then 'MONITOR' else 'ALLOW' end as action,
        case when final_score >= 0.75 then 'HIGH' when final_score >= 0.5 then 'MEDIUM' when final_score >= 0.3 then 'LOW' else 'NORMAL' end as risk from f""",
    "rule_features": f"with {L}, {V} select acct, {', '.join(f'max(case when rule = {k} then 1 else 0 end)::bigint as r{k}' for k in range(1, 13))} from (select distinct acct from l) left join v using (acct) group by acct",
    "pattern_rapid": f"with {L} {RAPID}",
    "pattern_round_trip": f"with {L} {TRIP}",
    "pattern_smurfing": f"with {L} {SMURFP}",
    "drill_down": f"with {L} select a.id, a.acct, count(b.id) - 1 as neighbours from l a join l b on a.acct = b.acct and abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000 where a.flagStatus = 'SUSPICIOUS' group by 1, 2",
    "relations": f"with {L}, {KEYED} select key, {MONEY}, count(distinct acct) as accounts, arg_max(shown, (ts, id)) as name, round(coalesce({C}, 0)::double - coalesce({D}, 0)::double, 2) as net, count(distinct acct) >= 2 as mutual from k where key is not null group by key",
    "relations_by_account": f"""with {L}, {KEYED} select 0::bigint as level, acct, key, {MONEY} from k where key is not null group by acct, key union all select 1, acct, '', {MONEY} from k where key is not null group by acct
      union all select 3, -1, '', {MONEY} from k where key is not null""",
    "account_activity": f"""with {L} select acct, 'h' || lpad(hour(ts)::varchar, 2, '0') as bucket, {MONEY} from l group by 1, 2 union all select acct, 'd' || dayofweek(ts)::varchar, {MONEY} from l group by 1, 2
      union all select acct, 'm' || strftime(ts, '%Y-%m'), {MONEY} from l group by 1, 2""",
    "account_profile": f"""with {L} select acct, count(*) as n, bool_or(strftime(ts, '%H:%M:%S') <> '00:00:00') as has_clock, case when bool_or(strftime(ts, '%H:%M:%S') <> '00:00:00') then count(*) filter (hour(ts) between 0 and 6) else 0 end as night,
      count(*) filter (dayofweek(ts) in (0, 6)) as weekend, count(distinct strftime(ts, '%Y-%m')) as months from l group by acct""",
    "counterparty_rating": f"""with {L}, {KEYED}, g as (select acct, key, {MONEY} from k where key is not null group by acct, key)
      select *, row_number() over (partition by acct order by n desc, credit + debit desc, key) as rank, case when n >= 10 and credit + debit >= 1000000 then 'FREQUENT_LARGE' when n >= 10 then 'FREQUENT_SMALL' when credit + debit >= 1000000 then 'RARE_LARGE' else 'RARE_SMALL' end as rating from g qualify rank <= 30""",
    "network_flow": f"""with {L} select *, case when value > 20000000 then 'critical' when value > 10000000 then 'high' when value > 1000000 then 'medium' else 'low' end as band from
      (select acct, cp, sum(amount)::double as value from l where cp is not null and cp <> '' group by all having sum(amount) > 0 order by value desc, acct, cp limit 30) where acct::varchar <> cp""",
    "totals_by_type": f"with {L} select acct, coalesce({C}, 0)::double as income, coalesce({D}, 0)::double as outgoing, date_diff('day', min(ts), max(ts)) as days from l group by acct",
    "direct_transfers": f"""with {L}, a as (select trim(accountNumber) as no, max(id) as other from bank_accounts where trim(accountNumber) <> '' group by 1),
      t as (select case when type = 'credit' then other else acct end as src, case when type = 'credit' then acct else other end as dst, strftime(ts, '%Y-%m') as month, amount from l join a on a.no = trim(l.cp) where acct <> other)
      select src, dst, month, count(*) as n, sum(amount)::double as total from t group by 1, 2, 3""",
    "two_sided_ledger": f"""with {L}, o as (select l.*, a.suspectId as holder from l left join bank_accounts a on a.id = l.acct), b as (select trim(accountNumber) as no, max(suspectId) as owner from bank_accounts where suspectId is not null group by 1),
      u as (select holder as person, type, amount from o where holder is not null union all select owner, case when type = 'credit' then 'debit' else 'credit' end, amount from o join b on b.no = trim(o.cp) where holder is null or holder <> owner)
      select person, count(*) as n, coalesce({C}, 0)::double as incoming, coalesce({D}, 0)::double as outgoing from u group by person""",
    "timeline_correlation": f"""with {L}, t as (select a.suspectId as s, l.id as txn, l.ts from l join bank_accounts a on a.id = l.acct where a.suspectId is not null), h as (
      select t.s as suspect, txn, c.id as call, abs(epoch_us(t.ts) - epoch_us(c.startTime)) as dt from t join call_records c on c.suspectId = t.s and cast(c.startTime as date) = cast(t.ts as date) where abs(epoch_us(t.ts) - epoch_us(c.startTime)) <= 7200000000),
      r as (select *, row_number() over (partition by suspect order by dt, txn, call) as rn from h qualify rn <= 200)
      select suspect, txn, call, (dt // 6000) / 10000.0::double as minutes, case when dt <= 9e8 then 'CRITICAL' when dt <= 1.8e9 then 'HIGH' when dt <= 3.6e9 then 'MEDIUM' else 'LOW' end as severity from (select * from r order by dt, txn, call limit 500)""",
    "located_events": f"with {L} select kind, location, count(*) as n from (select location, 'TXN' as kind from l union all select location, 'CALL' from call_records) where location is not null and location <> '' group by 1, 2",
    "links_financial": f"with {L}, {FIN} select * from fin",
    "links_shared_address": shared("address"),
    "links_shared_phone": shared(phone8("primaryPhone")),
    "links_phone": f"""with p as (select distinct k, p from (select id as p, {phone8('primaryPhone')} as k from suspects) where k is not null),
      c as (select coalesce(durationSeconds, 0) as sec, {phone8('callerNumber')} as k1, {phone8('calledNumber')} as k2 from call_records)
      select least(x.p, y.p) as a, greatest(x.p, y.p) as b, count(*) as n, sum(sec)::bigint as seconds, least(10, count(*) // 5 + 1)::bigint as strength, case when count(*) > 10 then 'HIGH' else 'MEDIUM' end as confidence
      from c join p x on x.k = k1 join p y on y.k = k2 where x.p <> y.p and k1 <> k2 group by 1, 2""",
    "association_matrix": f"""with {L}, {FIN}, two as (select a as r, b as c, n, total from fin union all select b, a, n, total from fin), cell as (select r as row, c as col, count(*) as links, sum(n)::bigint as events, round(sum(total), 2) as value from two group by 1, 2),
      top as (select greatest(max(events), 1) as me, greatest(max(value), 1) as mv from cell) select row, col, links, events, value, round(least(1.0, 0.5 * value / mv + 0.5 * events / me), 6)::double as strength from cell, top""",
    "chart_entities": """select id, fullName, round(350 + 200 * cos(i * 2 * 3.141592653589793::double / n), 4) as x, round(250 + 200 * sin(i * 2 * 3.141592653589793::double / n), 4) as y
      from (select id, fullName, row_number() over (order by id) - 1 as i, count(*) over () as n from suspects where riskLevel in ('HIGH', 'CRITICAL') and status = 'UNDER_INVESTIGATION')""",
    "dashboard": f"""with {L} select count(*) as transactions, sum(amount)::double as volume, count(*) filter (flagStatus in ('SUSPICIOUS', 'REVIEW')) as flagged, {AT.format('min(ts)')} as first_at, {AT.format('max(ts)')} as last_at,
      (select count(*) from suspects) as suspects, (select count(*) from suspects where riskLevel in ('HIGH', 'CRITICAL')) as high_risk, (select count(*) from suspects where status = 'UNDER_INVESTIGATION') as open,
      (select count(*) from call_records) as calls, (select count(*) from bank_accounts) as accounts from l""",
    "record_stats": f"""with {L} select acct, accountNumber, bankName, coalesce(accountHolderName, fullName) as owner, n, first_at, last_at from (select acct, count(*) as n, {AT.format('min(ts)')} as first_at, {AT.format('max(ts)')} as last_at from l group by acct)
      join bank_accounts a on a.id = acct left join suspects s on s.id = a.suspectId""",
    "suspect_holdings": """select s.id, fullName, coalesce(accounts, '') as accounts, coalesce(n, 0) as n from suspects s left join
      (select suspectId, string_agg(accountNumber, ',' order by accountNumber) as accounts, count(*) as n from bank_accounts where suspectId is not null group by 1) a on a.suspectId = s.id""",
    "reference_dedup": f"with {L} select acct, count(*) as n, sum(id)::bigint as ids from {DEDUP} group by acct",
    "access_dedup": "select min(event_id) as id, user_id as user, event_type as address, count(*) as copies from events group by cast(ts as date), user_id, event_type",
    "scan_distinct_callers": "select distinct callerNumber from call_records where callerNumber is not null",
    "scan_page": f"with {L} select id, acct, amt from l where acct = 1 order by ts desc, id desc limit 50 offset 100",
    "scan_neighbours": f"with {L} select id, amt from l where acct = 1 and abs({US} - epoch_us(timestamp '2024-01-01 00:00:00')) <= 1209600000000",
    "scan_suspect_calls": "select suspectId, count(*) as n from call_records where suspectId in (select id from suspects where riskLevel = 'CRITICAL') group by 1",
    "noise_filter": f"""with {L} select acct, count(*) as n, sum(amount)::double as total from l where not (amount < 5000 or lower(coalesce(description, '')) like 'atm%' or lower(coalesce(description, '')) like '%төлбөр%')
      and not exists (select 1 from l p where p.flagStatus = 'REVIEW' and p.acct = l.acct and p.cp = l.cp) group by acct""",
    "case_scope": f"with {L} select acct, count(*) as n, sum(amount)::double as total from l where acct in (select a.id from bank_accounts a join suspects s on s.id = a.suspectId where s.caseId in ('CASE-1', 'CASE-7', 'CASE-48')) group by acct",
    "purge_plan": f"""with {L}, g as (select id from suspects where caseId = 'CASE-7' and (nationalId is null or nationalId not in (select nationalId from suspects where caseId <> 'CASE-7' and nationalId is not null))),
      a as (select id from bank_accounts where suspectId in (select id from g)) select (select count(*) from g) as suspects, (select count(*) from a) as accounts, count(*) as transactions, coalesce(sum(amount), 0)::double as volume from l where acct in (select id from a)""",
    "bag_dedup": f"""with {L}, x as (select *, day(ts) as day, floor(amt / 1000)::bigint as whole from l), o as (select acct, type, day, whole, count(*) as have from x where year(ts) < 2024 group by all),
      n as (select *, row_number() over (partition by acct, type, day, whole order by id) as nth from x where year(ts) >= 2024) select acct, count(*) as n from n left join o using (acct, type, day, whole) where nth > coalesce(have, 0) group by acct""",
    "merge_renumber": """with e as (select caseId, id from suspects where caseId is not null) select id, id as exhibit from e where caseId = 'CASE-7' union all
      select id, (select coalesce(max(id), 0) from e where caseId = 'CASE-7') + row_number() over (order by caseId, id) from e where caseId <> 'CASE-7'""",
    "delete_account": f"with {L} select cp as id, count(*) as n from l where cp is not null and acct <> 1 group by cp",
    "entity_components": f"""with recursive k as (select id, 'n' || lower(trim(regexp_replace(coalesce(fullName, ''), '\\s+', ' ', 'g'))) as key from suspects union all select id, 'i' || trim(nationalId) from suspects where trim(nationalId) <> ''
      union all select id, 'p' || k from (select id, {phone8('primaryPhone')} as k from suspects) where k is not null),
      e as (select distinct x.id as a, y.id as b from k x join k y using (key)), r(id, root) as (select id, id from suspects union select e.b, r.root from r join e on e.a = r.id) select id, min(root) as person from r group by id""",
    "entity_counts": f"with {L} select acct as id, count(*) as n, 'account' as kind from l group by acct union all select suspectId, count(*), 'suspect' from call_records where suspectId is not null group by suspectId",
    "scalar_functions": f"""with {L} select id, ({DIGIT})::bigint as digit, hour(ts) as hour, dayofweek(ts) as weekday, week(ts) as week, isoyear(ts) as week_year, '₮ ' || format('{{:,}}', round(amount, 0)::bigint) as money, {NORM.format('cp_name')} as name,
      {NEAR} as near, {ROUND} as is_round, {OFF} as off, hour(ts) between 0 and 6 as night, dayofweek(ts) in (0, 6) as weekend, case when type = 'credit' then amt else -amt end as signed, upper(sha256(coalesce(description, ''))) as sha, {CL.format('cp_name')} as cleaned from l""",
    "export_transactions": f"""with {L} select coalesce(accountNumber, '') as account, coalesce(fullName, '') as owner, count(*) as n, sum(amount)::double as total from l left join bank_accounts a on a.id = acct left join suspects s on s.id = a.suspectId group by 1, 2""",
    "stream_daily_flows": f"""with {L} select acct, strftime(ts, '%Y-%m-%d') as day, coalesce({C}, 0)::double as inflow, coalesce({D}, 0)::double as outflow, count(*) as n,
      coalesce({C} > 10000000 and {D}::double > {C}::double * 0.9::double, false) as mule from l group by 1, 2""",
}


def burst(minutes: float) -> str:
    c = f"""c as (select *, t - t0 as d from (select callerNumber as acct, epoch_us(startTime) as t, row_number() over w as rn, lag(epoch_us(startTime), 4) over w as t0 from call_records
      where callerNumber is not null and startTime is not null window w as (partition by callerNumber order by epoch_us(startTime), id)) where t - t0 < {int(minutes * 60_000_000)}::bigint)"""
    step = "select acct, min(rn) as rn, arg_min(t0, rn) as t0, arg_min(d, rn) as d from c {} group by acct"
    h = f"h1 as ({step.format('')}), h2 as ({step.format('join (select acct, rn as last from h1) x using (acct) where rn >= last + 5')}), h3 as ({step.format('join (select acct, rn as last from h2) x using (acct) where rn >= last + 5')})"
    return f"(with {c}, {h} select * from h1 union all select * from h2 union all select * from h3)"


def burst_alerts(minutes: float) -> str:
    return _alert("BURST", "MEDIUM", "acct", "make_timestamp(t0)", "d", burst(minutes))


PLACES = ", ".join(f"('{k}', {lat!r}::double, {lng!r}::double)" for k, (lat, lng) in GAZETTEER.items())
KNOWN = "[" + ", ".join(f"'{k}'" for k in GAZETTEER) + "]"


def place_name(c: str) -> str:
    """The first token that the gazetteer knows, else the whole text if it does."""
    return f"""coalesce(list_filter(string_split_regex({c}, '[\\s,;./\\\\—\\-]+'), lambda t: length(t) >= 2 and list_contains({KNOWN}, lower(t)))[1], case when list_contains({KNOWN}, lower(trim({c}))) then trim({c}) end)"""


GAZ = f"g(k, lat, lng) as (values {PLACES})"
EVENTS = "ev as (select ts, location from l union all select startTime, location from call_records), e as (select ts, name, g.lat, g.lng from (select ts, {} as name from ev where location is not null and location <> '') x join g on g.k = lower(x.name))".format(place_name("location"))
# one byte for each letter: the distance counts bytes
LETTERS = "абвгдежзийклмнопрстуфхцчшщъыьэюяөүіöüé"
BYTES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#"[: len(LETTERS)]


def screened(c: str) -> str:
    return f"translate(lower(trim(regexp_replace({c}, '[\\x00-\\x1F]', '', 'g'))), 'ё', 'е')"


ORACLE_SQL |= {
    "pattern_burst": burst_alerts(7 * 24 * 60),
    "top_alerts": f"""with {L}, a as ({RAPID} union all {TRIP} union all {SMURFP} union all {burst_alerts(30)})
      select * from a order by case severity when 'CRITICAL' then 3 when 'HIGH' then 2 else 1 end desc, "at" desc, kind, subject, what limit 100""",
    "travel_correlation": f"""with {L}, t as (select o.suspectId as s, l.id as txn, epoch_us(ts) as tu, {place_name('l.location')} as tp from l join bank_accounts o on o.id = l.acct where o.suspectId is not null),
      c as (select suspectId as s, id as call, epoch_us(startTime) as cu, {place_name('location')} as cp from call_records where suspectId is not null and startTime is not null)
      select t.s as suspect, txn, call, tp as txn_place, cp as call_place, floor((cu - tu) / 6000::double) / 10000::double as minutes from t join c on c.s = t.s and abs(cu - tu) <= 14400000000 where tp is not null and cp is not null and lower(tp) <> lower(cp)""",
    "dwell_zones": f"""with {L}, {GAZ}, {EVENTS}, b as (select lat, lng, hour(ts) as h, count(*) as n, min(lower(name)) as name from e where ts is not null group by 1, 2, 3)
      select lat, lng, sum(n)::bigint as hits, arg_max(h, (n, -h))::bigint as peak_hour, min(name) as name, {", ".join(f"coalesce(sum(n) filter (h = {k}), 0)::bigint as h{k:02d}" for k in range(24))} from b group by 1, 2 order by hits desc, lat, lng limit 10""",
    "grid_density": f"""with {L}, {GAZ}, {EVENTS} select floor(lat / (5.0::double / 111))::bigint as gy, floor(lng / (5.0::double / 76))::bigint as gx, count(*) as n, round(avg(lat), 4) as lat, round(avg(lng), 4) as lng from e group by 1, 2""",
    "suspect_locations": f"""with {GAZ}, p as (select id, coalesce({place_name('address')}, {place_name('city')}) as place from suspects) select id, place, lat, lng from p join g on g.k = lower(place)""",
    "people": f"""with ec as ({ORACLE_SQL['entity_components']}), a as (select suspectId as id, count(*) as acc from bank_accounts where suspectId is not null group by 1),
      s as (select s.*, ec.person, coalesce(acc, 0) as acc, coalesce(list_position(['UNKNOWN', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], riskLevel), 1) as r, {phone8('primaryPhone')} as ph from suspects s join ec on ec.id = s.id left join a on a.id = s.id)
      select person, count(*) as records, ['UNKNOWN', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][greatest(max(r), 1)] as risk, sum(acc)::bigint as accounts, count(distinct ph) as phones, count(distinct caseId) as cases, arg_min(nationalId, id) filter (nationalId is not null) as national_id from s group by person""",
    "screening": f"""with p as (select distinct s, pc, n from (select s, pc, {screened('n')} as n from (select id as s, lower(country) as pc, unnest(list_concat([fullName], string_split_regex(coalesce(aliases, ''), '[;,|]'))) as n from suspects)) where length(n) >= 3),
      e as (select distinct e, ec, m from (select e, ec, {screened('m')} as m from (select id as e, lower(country) as ec, unnest(list_concat([caption], list_concat(coalesce(names, []), coalesce(aliases, [])))) as m from sanctions_entries)) where length(m) >= 3),
      h as (select s, e, pc, ec, case when n = m then 1.0 when len(list_filter(string_split_regex(n, '\\s+'), lambda t: not contains(m, t))) = 0 then 0.85 when contains(n, m) or contains(m, n) then 0.7
        when levenshtein(translate(n, '{LETTERS}', '{BYTES}'), translate(m, '{LETTERS}', '{BYTES}')) <= 2 then 0.55 end::double as score from p, e)
      select s as suspect, e as entry, round(least(1.0::double, max(score) + max(case when pc = ec then 0.05 else 0 end)::double), 2) as score from h where score is not null group by s, e""",
    "audit_verify": f"""with recursive {L}, o as (select acct as chain, id, row_number() over (partition by acct order by id) as rn, concat_ws('|', {AT.format('ts')}, coalesce(channel, ''), coalesce(flagStatus, ''), coalesce(cp, ''), coalesce(description, '')) as p from l),
      r(chain, rn, id, p, hash, prev) as (select chain, rn, id, p, upper(sha256('|' || p)), '' from o where rn = 1 union all select o.chain, o.rn, o.id, o.p, upper(sha256(r.hash || '|' || o.p)), r.hash from r join o on o.chain = r.chain and o.rn = r.rn + 1),
      v as (select chain, id, hash <> upper(sha256(prev || '|' || p || case when chain % 10 = 0 then '!' else '' end)) as bad from r) select chain, count(*) as events, min(id) filter (bad) as first_bad from v group by chain""",
    "fraud_workflow": f"""select a.acct, a.n, a.overall, a.risk as analysis_risk, a.verdict, r.final_score, r.action, r.risk, b.chi_square, b.passes, coalesce(k.bankName, 'Банк') || ' - ' || k.accountNumber as name
      from ({ORACLE_SQL['account_analysis']}) a join ({ORACLE_SQL['rule_scores']}) r using (acct) left join ({ORACLE_SQL['benford_test']}) b using (acct) left join bank_accounts k on k.id = a.acct""",
    "import_ledger": f"""with {L}, x as (select *, ref is not null and id > min(id) filter (ref is not null and not coalesce(contains(description, 'Эхний үлдэгдэл'), false)) over (partition by acct, ref) as again, coalesce(contains(description, 'Эхний үлдэгдэл'), false) as skip from l)
      select acct, case when skip then 'SKIPPED' when again then 'DUPLICATE' else 'IMPORTED' end as status, case when type = 'credit' then 'credit' else 'debit' end as type, count(*) as n, round(sum(amt), 2) as total,
        round(sum(1000 + case when type = 'credit' then amt else -amt end), 2) as balances from x group by all""",
    "import_calls": """with c as (select regexp_replace(callerNumber, '[^0-9+]', '', 'g') as caller, regexp_replace(calledNumber, '[^0-9+]', '', 'g') as called, coalesce(durationSeconds, 0) as sec, epoch_us(date_trunc('second', startTime)) as us,
        case when id % 5 = 0 then 2 else 1 end as times from call_records where startTime is not null)
      select caller, 'Outgoing' as direction, sum(times)::bigint as n, sum(sec * times)::bigint as seconds, min(us) as first_us from c where caller <> '' and called <> '' group by caller""",
    "import_access": """select min(event_id) as lineno, user_id as user, event_type as ip, epoch_us(cast(cast(ts as date) as timestamp)) as ts_us from events where ts is not null and user_id is not null group by user_id, event_type, cast(ts as date)""",
}

EVIDENCE = """own as (select s.caseId, a.id from bank_accounts a join suspects s on s.id = a.suspectId where s.caseId is not null),
  evd as (select o.caseId, 'TXN' as sourceType, l.id as sourceId, l.id as exhibit from l join own o on o.id = l.acct where flagStatus = 'SUSPICIOUS' union all select caseId, 'ACCOUNT', id, id from own)"""
THREE = "('CASE-1', 'CASE-7', 'CASE-48')"
GONE = "g as (select id from suspects where caseId = 'CASE-7' and (nationalId is null or nationalId not in (select nationalId from suspects where caseId <> 'CASE-7' and nationalId is not null))), ga as (select id from bank_accounts where suspectId in (select id from g))"
COMM = ORACLE_SQL["links_phone"]
ORACLE_SQL |= {
    "scan_lookup": "select id, accountNumber, bankName from bank_accounts where id = 1",
    "scan_page_total": f"with {L} select id, acct, amt, (select count(*) from l where acct = 1) as total_count from l where acct = 1 order by ts desc, id desc limit 25 offset 25",
    "locations_since": f"with {L} select location, count(*) as n from l where location is not null and location <> '' and ts >= timestamp '2022-06-01 00:00:00' group by 1",
    "audit_search": f"""with {L} select * from (select id, {AT.format('ts')} as "at", coalesce(channel, '') as actor, coalesce(flagStatus, '') as action from l) where "at" >= '2021-01-01' and contains(lower(actor), 'a') and contains(lower(action), 'susp') order by id desc limit 500""",
    "person_columns": """with w as (select id, list_filter(string_split_regex(trim(fullName), '\\s+'), lambda x: x <> '') as w, try_cast(case when regexp_matches(dateOfBirth, '^\\d{4}-\\d{2}-\\d{2}') then left(dateOfBirth, 10) end as date) as born from suspects)
      select id, upper(case when len(w) >= 2 then left(w[1], 1) || left(w[-1], 1) else left(w[1], 1) end) as initials, floor(date_diff('day', born, date '2026-01-01') / 365.25::double)::bigint as age from w""",
    "evidence_scope": f"""with {L}, {EVIDENCE}, x as (select * from evd where caseId in {THREE}), a as (select id from bank_accounts where suspectId in (select id from suspects where caseId in {THREE}) or id in (select sourceId from x where sourceType = 'ACCOUNT'))
      select acct, count(*) as n from l where acct in (select id from a) or id in (select sourceId from x where sourceType = 'TXN') group by acct""",
    "links_in_scope": f"with {L}, {FIN}, s as (select id from suspects where riskLevel in ('HIGH', 'CRITICAL', 'MEDIUM')) select a, b, n from fin where a in (select id from s) and b in (select id from s)",
    "scoped_dashboard": f"""with {L}, s as (select * from suspects where caseId in {THREE}), a as (select * from bank_accounts where suspectId in (select id from s))
      select count(*) as transactions, coalesce(sum(amount), 0)::double as volume, count(*) filter (flagStatus in ('SUSPICIOUS', 'REVIEW')) as flagged, {AT.format('min(ts)')} as first_at, {AT.format('max(ts)')} as last_at,
      (select count(*) from s) as suspects, (select count(*) from s where riskLevel in ('HIGH', 'CRITICAL')) as high_risk, (select count(*) from s where status = 'UNDER_INVESTIGATION') as open,
      (select count(*) from call_records where suspectId in (select id from s)) as calls, (select count(*) from a) as accounts from l where acct in (select id from a)""",
    "evidence_first": f"with {L}, {EVIDENCE} select caseId, arg_min(sourceId, (exhibit, sourceId)) as sourceId, any_value(title) as title from evd join (select caseId, 'Case of ' || count(*) as title from suspects where caseId is not null group by 1) c using (caseId) group by caseId",
    "calls_of_suspects": f"""with p as (select id as suspect, {phone8('primaryPhone')} as k from suspects), c as (select id, suspectId, {phone8('callerNumber')} as k1, {phone8('calledNumber')} as k2 from call_records)
      select suspectId as suspect, id as call from c where suspectId in (select id from suspects) union select suspect, id from c join p on p.k = k1 union select suspect, id from c join p on p.k = k2""",
    "qualified_transfers": f"""with {L}, o as (select a.id, trim(a.accountNumber) as no from bank_accounts a join suspects s on s.id = a.suspectId where s.status = 'UNDER_INVESTIGATION')
      select id, acct, amt from l where amount >= 1000000 and trim(cp) <> '' and (acct in (select id from o) or trim(cp) in (select no from o where no is not null))""",
    "flow_ranking": f"with {L}, {KEYED}, r as (select key, {MONEY} from k where key is not null group by key) select * from (select key, 'IN' as flow, credit as value from r union all select key, 'OUT', debit from r) where value > 0 order by value desc, key, flow limit 15",
    "verdict_period": f"with {L} select {AT.format('min(ts)')} as first_at, {AT.format('max(ts)')} as last_at from l",
    "owner_ordered": f"""with st as ({ORACLE_SQL['record_stats']}), x as (select acct, owner, n, coalesce('o:' || owner, 'a:' || acct) as k from st) select acct, owner, n, busiest from (select *, max(n) over (partition by k) as busiest from x) order by busiest desc, k, n desc, acct limit 200""",
    "relations_ordered": f"with {L}, {KEYED}, r as (select key, {MONEY} from k where key is not null group by key) select key, n from r order by n desc, credit + debit desc, key limit 60",
    "transfers_ordered": f"select src, dst, sum(n)::bigint as n, round(sum(total), 2) as total from ({ORACLE_SQL['direct_transfers']}) group by 1, 2 order by total desc, src, dst limit 60",
    "people_ordered": f"select person, cases, records from ({ORACLE_SQL['people']}) order by cases desc, records desc, person limit 100",
    "screening_ordered": f"select * from ({ORACLE_SQL['screening']}) order by score desc, suspect, entry limit 50",
    "links_replaced": f"with {L}, {FIN}, s as ({ORACLE_SQL['links_shared_address']}) select kind, count(*) as n, sum(a)::bigint as a, sum(b)::bigint as b from (select 'MANUAL' as kind, a, b from s union all select 'FINANCIAL', a, b from fin) group by kind",
    "evidence_tagged": f"with {L}, {EVIDENCE} select caseId, count(*) as n, max(exhibit) filter (sourceType = 'ACCOUNT') + count(*) filter (sourceType = 'TXN') as last from evd group by caseId",
    "delete_case": f"""with {L}, {GONE} select 'suspects' as name, count(*) as n from suspects where id not in (select id from g) union all select 'accounts', count(*) from bank_accounts where id not in (select id from ga)
      union all select 'transactions', count(*) from l where acct not in (select id from ga) union all select 'calls', count(*) from call_records where suspectId is null or suspectId not in (select id from g)""",
    "flow_nodes": f"""with f as (select acct, cp, row_number() over (order by value desc, acct, cp) as rn from ({ORACLE_SQL['network_flow']})), nd as (select 'a:' || acct as node, rn * 2 as "at", acct from f union all select 'c:' || cp, rn * 2 + 1, null from f),
      gr as (select node, min("at") as "at", max(acct) as acct from nd group by node) select node, row_number() over (order by "at") - 1 as index, case when riskLevel in ('CRITICAL', 'HIGH') then 'red' when riskLevel = 'MEDIUM' then 'orange' when riskLevel = 'LOW' then 'green' else 'grey' end as colour
      from gr left join bank_accounts b on b.id = gr.acct left join suspects s on s.id = b.suspectId""",
    "drill_down_rows": f"with {L} select a.id as target, b.id as related, floor((epoch_us(b.ts) - epoch_us(a.ts)) / 6000::double) / 10000::double as minutes from l a join l b on a.acct = b.acct and a.id <> b.id and abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000 where a.flagStatus = 'SUSPICIOUS'",
    "strongest_links": f"""with {L}, {FIN}, ph as ({COMM}), u as (select 'FINANCIAL' as kind, a, b, n, strength from fin union all select 'COMMUNICATION', a, b, n, strength from ph), two as (select a as row, b as col, kind, n, strength from u union all select b, a, kind, n, strength from u)
      select row, col, sum(n)::bigint as events, coalesce(sum(n) filter (kind = 'COMMUNICATION'), 0)::bigint as communications, arg_min(kind, (-strength, kind)) as strongest from two group by 1, 2""",
}
