"""Queries of this subpackage and the SQL of those that SQL can express."""

from moneytrail.llm.batches import p6_found
from moneytrail.llm.encoding import p8_ids
from moneytrail.llm.languages import p10_found, p10_segments
from moneytrail.llm.leakage import p9_found
from moneytrail.llm.matching import p7_found, p7_matches
from moneytrail.llm.nearest import p4_found
from moneytrail.llm.variants import p1_classes, p1_found

QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p4_found, p6_found, p7_found, p7_matches, p8_ids, p9_found, p10_found, p10_segments)}
ORACLE_SQL: dict[str, str] = {
    "p4_found": """
        with t as (select t.id, a.suspectId as s, t.timestamp as ts from bank_transactions t
                   join bank_accounts a on a.id = t.bankAccountId where a.suspectId is not null),
             c as (select id, suspectId as s, startTime as st from call_records where suspectId is not null),
             d as (select t.id as txnid, c.id as callid, abs(epoch_us(t.ts) - epoch_us(c.st)) as far
                   from t join c on t.s = c.s and c.st between t.ts - interval 30 minute and t.ts + interval 30 minute)
        select txnid, callid from d
        qualify row_number() over (partition by txnid order by far, callid) = 1""",
}
