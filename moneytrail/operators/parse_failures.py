"""Problem 5: rows that fail to parse, with the reason; problem 2 shares the field lookup."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moneytrail.functions.text import similarity, skeleton, undecorated
from moneytrail.plans.session import spread, table
from moneytrail.sources import delimited

DATES = {"date", "datetime", "timestamp"}
NUMBERS = {"amount", "credit", "debit", "balance", "duration"}
CLOSE = 0.75  # least similarity of a header to the known one that it varies
PROFILES = 10_000  # most import profiles that are sent to the executors

Known = list[tuple[str, str, str]]  # profile, field, header


def known_headers(profiles: DataFrame) -> Known:
    """(profile, field, known header) of all profiles: a configuration table, its size checked."""
    rows = profiles.select("profileId", F.explode("fieldMap").alias("field", "headers")).select("profileId", "field", F.explode("headers").alias("h")).limit(PROFILES + 1).collect()
    if len(rows) > PROFILES:
        raise ValueError("too many known headers for a configuration table")
    return [(r["profileId"], r["field"], delimited.clean_header(r["h"])) for r in rows if r["h"]]


class Fields:
    """Finds the field that a header stands for."""

    def __init__(self, known: Known):
        self.exact: dict[str, list[tuple[str, str]]] = {}
        for profile, field, header in known:
            self.exact.setdefault(header, []).append((profile, field))
        self.folded = [(profile, field, skeleton(header)) for profile, field, header in known]
        self._memo: dict[tuple[str, str | None], str | None] = {}

    def profile_of(self, headers: list[str], stated: str | None) -> str | None:
        """The stated profile, else the one that knows most of the headers."""
        if stated:
            return stated
        votes: dict[str, float] = {}
        for h in headers:
            s = skeleton(undecorated(h))
            for profile in {p for p, _, k in self.folded if similarity(s, k) >= CLOSE}:
                votes[profile] = votes.get(profile, 0) + 1
        return max(votes, key=lambda p: (votes[p], p)) if votes else None

    def field_of(self, header: str, profile: str | None) -> str | None:
        key = (header, profile)
        if key not in self._memo:
            self._memo[key] = self._find(header, profile)
        return self._memo[key]

    def _find(self, header: str, profile: str | None) -> str | None:
        for p, f in self.exact.get(header, ()):
            if profile in (p, None):
                return f
        best, found = CLOSE, None
        for s in {skeleton(header), skeleton(undecorated(header))}:
            for p, f, k in self.folded:
                if profile in (p, None) and (r := similarity(s, k)) >= best and (r > best or found is None):
                    best, found = r, f
        return found


def classify(content: str | None, profile: str | None, fields: Fields) -> list[tuple[int, str | None, list[str], str]]:
    """(line, reason or None, fields, raw text) of each record of a file.

    The records are read permissively, the raw text kept; a reason is the first that holds of
    quoting, column_count and value.  A date column's own form is the one most of its values have."""
    p = delimited.parse(content)
    profile = fields.profile_of(p.header, profile)
    roles = [fields.field_of(h, profile) for h in p.header]
    rows = p.rows()
    forms = {k: delimited.column_form([f[k] for _, f in rows]) for k, r in enumerate(roles) if r in DATES}
    out = []
    for no, raw, f, quoted in p.records:
        reason = None
        if not quoted:
            reason = "quoting"
        elif len(f) != len(p.header):
            reason = "column_count"
        else:
            for k, r in enumerate(roles):
                if r in DATES:
                    form, month_first = forms[k]
                    bad = not f[k].strip() or (form is not None and not delimited.exists(f[k], form, month_first))
                elif r in NUMBERS:
                    bad = bool(f[k].strip()) and delimited.plain_number(f[k]) is None
                else:
                    bad = False
                if bad:
                    reason = "value"
                    break
        out.append((no, reason, f, raw))
    return out


def parse_files(files: DataFrame, profiles: DataFrame) -> DataFrame:
    """(fileid, lineno, reason, fields, raw) of every record of files (fileId, content, profileId):
    reason is null for valid rows.

    One scan without a shuffle; null or empty content has no record; a file without a line of
    two fields has none either; extra columns are ignored."""
    spark = files.sparkSession
    shared = spark.sparkContext.broadcast(known_headers(profiles))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = Fields(shared.value)
        for b in batches:
            rows = [(i, no, why, f, raw) for i, c, p in zip(b.fileId, b.content, b.profileId) for no, why, f, raw in classify(c, p, fields)]
            yield pd.DataFrame(rows, columns=["fileid", "lineno", "reason", "fields", "raw"])

    return spread(files.select("fileId", "content", "profileId")).mapInPandas(run, "fileid long, lineno long, reason string, fields array<string>, raw string")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse_files(table(spark, sf_dir, "import_files"), table(spark, sf_dir, "import_profiles"))
    return found.where("reason is not null").select("fileid", "lineno", "reason")


def p5_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid rows."""
    found = parse_files(table(spark, sf_dir, "import_files"), table(spark, sf_dir, "import_profiles"))
    return found.where("reason is null").select("fileid", "lineno", "fields")
