"""Problem 2: schemas that drift between the files of a feed.

A file's schema is a tree (its root the file, a leaf per column; nested schemas have inner
nodes).  The unordered tree edit distance between a file and the one before it in its feed
gives the cheapest script of added, removed, renamed, retyped and moved nodes; a rename is
cheap only if the data stays.  Scripts compile into projections onto one table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moneytrail.functions.scalars import clean_amount, read_datetime
from moneytrail.functions.text import similarity, skeleton, undecorated
from moneytrail.operators.parse_failures import NUMBERS, Fields, classify, known_headers
from moneytrail.plans.session import save, spread, table
from moneytrail.sources import delimited

ADD = DELETE = 1.0
RETYPE = 0.2
NAME = 0.7  # least similarity of related headers
WORDS = 40  # frequent words of a column that are kept to compare its data


@dataclass(eq=False)
class Node:
    """A column or group of columns: its header, the field it stands for, and its data in short."""

    name: str
    stands: str | None = None
    kind: str = ""
    empty: float = 0.0
    shapes: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    children: list["Node"] = field(default_factory=list)


def column_node(name: str, known: str | None, values: list[str]) -> Node:
    full = [v.strip() for v in values if v.strip()]
    shapes = Counter(re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "9", v))[:40] for v in full)
    words = Counter(w for v in full for w in set(re.findall(r"[^\W\d_]{2,}", v.lower())))
    return Node(
        name, known, delimited.column_type(values), round(1 - len(full) / max(1, len(values)), 4),
        [s for s, _ in sorted(shapes.items(), key=lambda c: (-c[1], c[0]))[:5]], [w for w, _ in sorted(words.items(), key=lambda c: (-c[1], c[0]))[:WORDS]],
    )


def type_changed(a: str, b: str) -> bool:
    """Kinds differ as far as it counts: an epoch number differs from dates and times only, and
    from numbers with fraction, flags and texts as a whole number does."""
    if not a or not b or a == b:
        return False
    return {a, b} != {"whole", "epoch"}


def _overlap(a: list[str], b: list[str]) -> float:
    x, y = set(a), set(b)
    return len(x & y) / max(1, min(len(x), len(y)))


def rename_cost(a: Node, b: Node) -> float:
    """Cost of calling a's column b: below ADD + DELETE only if the data stays the same kind."""
    if a.kind and b.kind and type_changed(a.kind, b.kind):
        return 9.0
    x, y = skeleton(undecorated(a.name)), skeleton(undecorated(b.name))
    near = max(similarity(x, y), similarity(skeleton(a.name), skeleton(b.name)))
    if a.stands and a.stands == b.stands:
        return 0.3
    if a.stands and b.stands:
        return 9.0
    if near >= NAME:
        return 0.5 + (1 - near)
    if a.kind == "text" and a.words and b.words:
        return 1.2 if _overlap(a.words, b.words) >= 0.5 and abs(a.empty - b.empty) <= 0.2 else 9.0
    if a.stands or b.stands or not a.kind or not b.kind:
        return 9.0
    return 1.6 if _overlap(a.shapes, b.shapes) >= 0.6 and abs(a.empty - b.empty) <= 0.15 else 9.0


def size(n: Node) -> float:
    return 1.0 + sum(map(size, n.children))


MOVE = 0.6  # of a subtree that keeps its name under another parent

Step = tuple[str, str, str]  # kind, old header, new header


def best_assignment(gain: dict[tuple[int, int], float], rows: int, columns: int) -> dict[int, int]:
    """Row to column so that the sum of gains (0 where there is none) is greatest, by shortest augmenting
    paths with potentials; pairs without gain stay unmatched."""
    if not gain:
        return {}
    n = max(rows, columns)
    cost = [[-gain.get((i, j), 0.0) for j in range(n)] for i in range(n)]
    u, v, owner = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)  # owner[j]: row of column j; n: none
    for i in range(n):
        owner[n], j0 = i, n
        least, used, back = [float("inf")] * (n + 1), [False] * (n + 1), [n] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = owner[j0], float("inf"), n
            for j in range(n):
                if not used[j]:
                    c = cost[i0][j] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], back[j] = c, j0
                    if least[j] < delta - 1e-12:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if owner[j0] == n:
                break
        while j0 != n:
            owner[j0], j0 = owner[back[j0]], back[j0]
    return {owner[j]: j for j in range(columns) if (owner[j], j) in gain}


def _edit(a: Node, b: Node, at: str, to: str) -> tuple[float, list[tuple[str, str, str, Node | None, str]]]:
    """(cost, script) from the children of a to those of b, each step with the subtree it takes or brings and its path."""
    cost, script = 0.0, []
    by_name = {c.name: c for c in b.children}
    same = [c for c in a.children if c.name in by_name]
    for c in same:
        d = by_name[c.name]
        if not c.children and not d.children and type_changed(c.kind, d.kind):
            cost += RETYPE
            script.append(("retyped", c.name, c.name, None, ""))
        sub, steps = _edit(c, d, f"{at}{c.name}.", f"{to}{d.name}.")
        cost += sub
        script += steps
    names = {c.name for c in same}
    old = [c for c in a.children if c.name not in names]
    new = [c for c in b.children if c.name not in names]
    gain = {}
    for i, c in enumerate(old):
        for j, d in enumerate(new):
            full = rename_cost(c, d) + (_edit(c, d, "", "")[0] if c.children or d.children else 0.0)
            if full < size(c) + size(d):
                gain[i, j] = size(c) + size(d) - full
    pairs = best_assignment(gain, len(old), len(new))
    for i, c in enumerate(old):
        if i in pairs:
            d = new[pairs[i]]
            sub, steps = _edit(c, d, f"{at}{c.name}.", f"{to}{d.name}.")
            cost += rename_cost(c, d) + sub
            script += [("renamed", c.name, d.name, None, ""), *steps]
        else:
            cost += DELETE * size(c)
            script.append(("removed", c.name, "", c, at + c.name))
    for j, d in enumerate(new):
        if j not in pairs.values():
            cost += ADD * size(d)
            script.append(("added", "", d.name, d, to + d.name))
    return cost, script


def tree_edit(a: Node, b: Node) -> tuple[float, list[Step]]:
    """(cost, script) from the children of a to those of b, order ignored.

    Nodes of one name under one parent are the same node; the rest are matched so that the sum of
    renames, deletions and additions of whole subtrees is least.  A subtree taken away under one
    parent and added with its name under another is moved (headers with their parents', joined by dots), with the
    changes inside it."""
    cost, script = _edit(a, b, "", "")
    gone = {(k, s[3].name): s for k, s in enumerate(script) if s[0] == "removed" and s[3]}
    out: list[Step] = []
    taken = set()
    moves = {}
    for k, s in enumerate(script):
        if s[0] == "added":
            source = next((g for g in gone if g[1] == s[3].name and g not in taken), None)
            if source is not None:
                taken.add(source)
                moves[k] = source
    for k, (kind, old, new, node, path) in enumerate(script):
        if k in moves:
            before, source = gone[moves[k]][3:]
            sub, steps = _edit(before, node, f"{source}.", f"{path}.")
            if not before.children and not node.children and type_changed(before.kind, node.kind):
                sub += RETYPE
                steps = [("retyped", new, new, None, ""), *steps]
            cost += MOVE + sub - DELETE * size(before) - ADD * size(node)
            out += [("moved", source, path), *(s[:3] for s in steps)]
        elif not any(t[0] == k for t in taken):
            out.append((kind, old, new))
    return cost, out


COLUMNS = "array<struct<name:string,field:string,kind:string,empty:double,shapes:array<string>,words:array<string>>>"


def file_schemas(files: DataFrame, profiles: DataFrame) -> DataFrame:
    """(fileid, feedid, seqno, columns) of each file that has a header."""
    shared = files.sparkSession.sparkContext.broadcast(known_headers(profiles))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = Fields(shared.value)
        for b in batches:
            out = []
            for i, feed, seq, content, profile in zip(b.fileId, b.feedId, b.seqNo, b.content, b.profileId):
                p = delimited.parse(content)
                profile = fields.profile_of(p.header, profile)
                rows = p.rows()
                cols = []
                for k, h in enumerate(p.header):
                    n = column_node(h, fields.field_of(h, profile), [f[k] for _, f in rows])
                    cols.append({"name": n.name, "field": n.stands, "kind": n.kind, "empty": n.empty, "shapes": n.shapes, "words": n.words})
                if p.header:
                    out.append((i, feed, seq, cols))
            yield pd.DataFrame(out, columns=["fileid", "feedid", "seqno", "columns"])

    return spread(files.select("fileId", "feedId", "seqNo", "content", "profileId")).mapInPandas(run, f"fileid long, feedid string, seqno long, columns {COLUMNS}")


def _node(columns) -> Node:
    return Node("", children=[Node(c["name"], c["field"], c["kind"], c["empty"], list(c["shapes"]), list(c["words"])) for c in columns])


def _scripts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for i, old, new in zip(b.fileid, b.old, b["columns"]):
            out += [(i, *step) for step in dict.fromkeys(tree_edit(_node(old), _node(new))[1])]
        yield pd.DataFrame(out, columns=["fileid", "changekind", "oldheader", "newheader"])


def _steps(schemas: DataFrame) -> DataFrame:
    order = Window.partitionBy("feedid").orderBy("seqno", "fileid")
    before = schemas.select("fileid", "feedid", "seqno").withColumn("prev", F.lag("fileid").over(order)).where("prev is not null").select("fileid", "prev")
    pairs = schemas.select("fileid", "columns").join(before, "fileid").join(schemas.select(F.col("fileid").alias("prev"), F.col("columns").alias("old")), "prev")
    return pairs.select("fileid", "old", "columns").mapInPandas(_scripts, "fileid long, changekind string, oldheader string, newheader string")


def _placed_schemas(files: DataFrame, profiles: DataFrame) -> DataFrame:
    return save(file_schemas(files, profiles).where("feedid is not null and seqno is not null"))


def schema_changes(files: DataFrame, profiles: DataFrame) -> DataFrame:
    """(fileid, changekind, oldheader, newheader): the edit script of each file against the one before it in its feed.

    Predecessors are found on three narrow columns; schemas (a few hundred bytes a file) are
    then joined on feed and position, so a feed of any length spreads over all tasks.  Files
    without feed, position or header take no part; the first of a feed has no changes."""
    return _steps(_placed_schemas(files, profiles))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(table(spark, sf_dir, "import_files"), table(spark, sf_dir, "import_profiles"))


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files in order of feed and position: the chain of renames that each column belongs to."""
    feed, chain_of, before, names, last = None, {}, set(), [], []
    for b in batches:
        out = []
        for i, f, headers, stands, old, new in zip(b.fileid, b.feedid, b.headers, b.stands, b.old, b.new):
            if f != feed:
                feed, chain_of, before, names, last = f, {}, set(), [], []
            renamed = {} if new is None else dict(zip(new, old))
            # columns of the file before keep their chain; a header not seen, or whose chain is another's now, begins one
            here = {h: chain_of[renamed[h]] for h in headers if renamed.get(h) in chain_of}
            here |= {h: chain_of[h] for h in headers if h not in here and h in before}
            for h in headers:
                if h in here:
                    continue
                c = chain_of.get(h)
                if c is None or c in here.values():
                    own = undecorated(h)
                    names.append(own if c is None else f"{own} {sum(n == own or n.startswith(own + ' ') for n in names) + 1}")
                    last.append(None)
                    c = len(names) - 1
                here[h] = c
            for h, s in zip(headers, stands):
                c = here[h]
                last[c] = s or last[c]
                out.append((i, f, c, h, s, last[c], names[c]))
            chain_of |= here
            before = set(here)
        yield pd.DataFrame(out, columns=["fileid", "feedid", "chain", "header", "field", "carried", "first"])


def projections(files: DataFrame, profiles: DataFrame) -> DataFrame:
    """(fileid, headers, names): the headers of a file that its feed's edit scripts give another name than their own.

    A column that is renamed from file to file is one chain.  It bears the field that its header
    stands for, else the last one known before in its chain, else the first one after, else the
    undecorated header it began with.  Scripts are composed by one task a feed in order of
    position, which keeps a number for each header; only headers and renames go there."""
    schemas = _placed_schemas(files, profiles)
    renamed = _steps(schemas).where("changekind = 'renamed'").groupBy("fileid").agg(F.collect_list(F.struct("oldheader", "newheader")).alias("r")).select("fileid", F.col("r.oldheader").alias("old"), F.col("r.newheader").alias("new"))
    narrow = schemas.select("fileid", "feedid", "seqno", F.col("columns.name").alias("headers"), F.col("columns.field").alias("stands")).join(renamed, "fileid", "left")
    ordered = narrow.repartition("feedid").sortWithinPartitions("feedid", "seqno", "fileid")
    chains = save(ordered.select("fileid", "feedid", "headers", "stands", "old", "new").mapInPandas(_chained, "fileid long, feedid string, chain long, header string, field string, carried string, first string"))
    at = schemas.select("fileid", F.struct("seqno", "fileid").alias("at"))
    later = chains.where("field is not null").join(at, "fileid").groupBy("feedid", "chain").agg(F.min_by("field", "at").alias("later"))
    named = chains.where("field is null").join(later, ["feedid", "chain"], "left").select("fileid", "header", F.coalesce("carried", "later", "first").alias("name"))
    return named.distinct().groupBy("fileid").agg(F.collect_list(F.struct("header", "name")).alias("p")).select("fileid", F.col("p.header").alias("headers"), F.col("p.name").alias("names"))


def unified(files: DataFrame, profiles: DataFrame, valid: bool = True) -> DataFrame:
    """(fileid, feedid, lineno, data): the valid rows of all files in one table; with valid=False also
    (profile) and, with null data, the lines that don't parse, and one without lineno for each file's header.

    data maps each field (for a header that stands for none, the name of its column in the
    feed, see projections; outside a feed its undecorated name) to its value: the projection
    that the edit scripts up to a file compile to.  Empty values are null; two columns of one
    name keep the first non-empty value, but a column renamed from a field that another header
    of the file stands for keeps its own undecorated name."""
    shared = files.sparkSession.sparkContext.broadcast(known_headers(profiles))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = Fields(shared.value)
        for b in batches:
            out = []
            for i, feed, content, profile, headers, names in zip(b.fileId, b.feedId, b.content, b.profileId, b.headers, b.names):
                header = delimited.parse(content).header
                known = fields.profile_of(header, profile)
                carried = {} if headers is None else dict(zip(headers, names))
                own = {h: fields.field_of(h, known) for h in header}
                taken = {f for f in own.values() if f}
                target = [own[h] or (carried[h] if h in carried and carried[h] not in taken else undecorated(h)) for h in header]
                if header and not valid:
                    out.append((i, feed, None, None, known))
                for no, why, f, _ in classify(content, profile, fields):
                    row: dict[str, str | None] | None = None
                    if why is None:
                        row = {}
                        for t, v in zip(target, f):
                            row[t] = row.get(t) or v.strip() or None
                    if why is None or not valid:
                        out.append((i, feed, no, row, known))
            rows = pd.DataFrame(out, columns=["fileid", "feedid", "lineno", "data", "profile"])
            yield rows.astype({"lineno": "Int64"})

    names = projections(files, profiles).withColumnRenamed("fileid", "fileId")
    whole = files.select("fileId", "feedId", "content", "profileId").join(names, "fileId", "left")
    rows = spread(whole).mapInPandas(run, "fileid long, feedid string, lineno long, data map<string,string>, profile string")
    return rows.drop("profile") if valid else rows


def typed(rows: DataFrame) -> DataFrame:
    """rows with the values of known fields in one form whatever a file's: (at_us) of the date, (amounts) of
    the numeric fields, as their column was retyped between text forms, epoch numbers and dates."""
    g = lambda f: F.try_element_at("data", F.lit(f))
    stated = F.coalesce(*(g(f) for f in ("date", "datetime", "timestamp")))
    epoch = F.when(stated.rlike(r"^\d{10}$"), stated.try_cast("long") * 1_000_000).when(stated.rlike(r"^\d{13}$"), stated.try_cast("long") * 1000)
    numbers = F.map_filter("data", lambda k, v: k.isin(*sorted(NUMBERS)) & v.isNotNull())
    return rows.withColumn("at_us", F.coalesce(epoch, read_datetime(stated))).withColumn("amounts", F.transform_values(numbers, lambda k, v: clean_amount(v)))


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(unified(table(spark, sf_dir, "import_files"), table(spark, sf_dir, "import_profiles")))
