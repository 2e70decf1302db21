"""Problem 7: the same persons in two sources without a common key.

Candidates come from all attributes: each name token's forms with one letter (two in long
words) left out, for very long ones MinHash bands over its letter pairs, give tokens that are
one word; names that agree in two tokens, one of which may be shortened, are candidates,
however common; so are records with one token and the whole birth date in common, if
another token is alike.  Names, birth dates and countries give features; a logistic classifier
trained here on a bounded sample of reviewed pairs, and on weak labels that names and birth
dates give by themselves, gives probabilities, calibrated on a part of the pairs that it
wasn't trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moneytrail.functions.times import read_birth
from moneytrail.llm import names
from moneytrail.plans.session import discard, save, table

BANDS, ROWS = 24, 2
LONG = 12  # letters from which a token has bands besides
FORMS = 24  # letters up to which a token is blocked by its forms with letters left out; beyond by its pieces
PIECES = 5  # of a longer token: two left-out and two put-in letters leave one of them whole
LABELS = 20_000  # most reviewed pairs that the classifier is fitted on
WEAK = 2_000  # most weakly labelled pairs of each kind that it is fitted on
WEAK_WEIGHT = 0.1  # of a weakly labelled pair, a reviewed one counting 1
REST = 0.6  # least ratio of the other words of names that meet by one word and the birth date
THRESHOLD = 0.5
FEATURES = [
    "name_full", "name_short", "nickname", "rest", "ratio", "birth_day", "birth_month", "birth_year", "birth_swapped",
    "birth_one_digit", "birth_same_year", "birth_conflict", "birth_missing", "country_same", "country_differs",
]

_MASK = (1 << 61) - 1
_rng = np.random.default_rng(7)
_A = _rng.integers(1, _MASK, BANDS * ROWS, dtype=np.int64).astype(object)
_B = _rng.integers(0, _MASK, BANDS * ROWS, dtype=np.int64).astype(object)


def token_bands(token: str) -> list[int]:
    """Band hashes of the MinHash signature of a token's letter pairs, ends included."""
    import xxhash

    t = f"^{names.folded(token)}$"
    grams = {xxhash.xxh32_intdigest(t[i : i + 2]) for i in range(len(t) - 1)}
    g = np.array(sorted(grams), dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = (g[None, :] * _A.astype(np.uint64)[:, None] + _B.astype(np.uint64)[:, None]) >> np.uint64(20)
    sig = h.min(axis=1).reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), seed=k) >> 1 for k, row in enumerate(sig)]


def piece_keys(w: str) -> set[str]:
    """Texts of which two words of more than FORMS letters share one if at most two letters are left out
    of each: the pieces of a word, and what stands in another about where they would be."""
    out = set()
    for n in range(len(w) - 2, len(w) + 3):  # of a word of n letters
        cut = [k * n // PIECES for k in range(PIECES + 1)]
        for k, (i, j) in enumerate(zip(cut, cut[1:])):
            out |= {f"{n}:{k}:{w[i + d : j + d]}" for d in range(-2, 3) if i + d >= 0 and j + d <= len(w)}
    return out


def token_keys(token: str) -> list[int]:
    """Keys of which two tokens that names.same_token accepts share one: of the folded word and of
    the word itself, all forms with at most one letter left out (from names.LONG letters on two:
    a common subsequence that long leaves one form equal), or pieces where it is very long.  Long
    words have bands besides."""
    import xxhash

    out = set()
    for how, w, least in zip("fr", token.split("="), (5, 4)):  # shorter words bear no error
        if len(w) <= FORMS + 2:
            forms = {w}
            if len(w) >= least:
                forms |= {w[:k] + w[k + 1 :] for k in range(len(w))}
            if len(w) >= names.LONG:
                forms |= {x[:k] + x[k + 1 :] for x in list(forms) for k in range(len(x))}
            out |= {xxhash.xxh64_intdigest(f"{how}{x}") >> 1 for x in forms}
        if len(w) > FORMS:
            out |= {xxhash.xxh64_intdigest(f"{how}{x}") >> 1 for x in piece_keys(w)}
        if len(w) >= LONG - 1:
            out |= {h ^ ord(how) for h in token_bands(w)}
    return sorted(out)


def _names_of(full: str | None, aliases: str | None, listed) -> list[str]:
    out = names.record_names(full, aliases)
    for x in () if listed is None else listed:
        out += [p for p in names.record_names(x, None)]
    return [names.joined(p) for p in dict.fromkeys(out)]


def _named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [_names_of(f, a, x) for f, a, x in zip(b["name"], b.aliases, b.listed)]
        yield b.assign(names=got)[["id", "names", "births", "country"]]


def with_names(people: DataFrame) -> DataFrame:
    """(id, names, births, country): the parsed names of people (id, name, aliases, listed, births, country)."""
    return people.select("id", "name", "aliases", "listed", "births", "country").mapInPandas(
        _named, "id string, names array<string>, births array<string>, country string"
    )


def _spelt(df: DataFrame) -> DataFrame:
    """(id, n) of each name of each person."""
    return df.select("id", F.explode("names").alias("n")).distinct()


def parts_of(named: DataFrame) -> DataFrame:
    """named with kind and the tokens t of its names n."""
    p = F.split("n", r"\|")
    return named.withColumn("kind", p[0]).withColumn("t", F.slice(p, F.lit(2), F.size(p)))


def token_pairs(full: DataFrame) -> DataFrame:
    """full (..., t) with a row (x, y) for each two tokens of a name, in alphabetical order as names keep them."""
    first = full.select("*", F.posexplode("t").alias("i", "x"))
    return first.select(*[c for c in full.columns if c != "t"], "x", F.explode(F.expr("slice(t, i + 2, size(t))")).alias("y"))


def _key_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(t, h) for t in b.t for h in token_keys(t)]
        yield pd.DataFrame(rows, columns=["t", "key"])


def _same_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b[[names.same_token(t, u) for t, u in zip(b.t, b.t2)]]


def near_tokens(left: DataFrame, right: DataFrame) -> DataFrame:
    """(t, t2): tokens (t) of both sides that share a key and are the same word by names.same_token."""
    lb, rb = (spread_rows(x.distinct()).mapInPandas(_key_rows, "t string, key long") for x in (left, right))
    met = lb.join(rb.withColumnRenamed("t", "t2"), "key").select("t", "t2").distinct()
    return met.where("t = t2").unionByName(spread_rows(met.where("t <> t2")).mapInPandas(_same_tokens, "t string, t2 string"))


def spread_rows(df: DataFrame) -> DataFrame:
    """df in as many tasks as there are cores at least: adaptive execution joins small partitions by
    their bytes, but what follows costs by the row."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def sides(full: DataFrame, own: bool) -> DataFrame:
    """(s, many, t, long, k, size): each token t of a name (s, t, many) with the keys k of each other token,
    size letters long, as a whole one (own) or as a shortened form: two share a key if one shortens the other."""
    letters = lambda c: F.substring_index(c, "=", 1)
    # names.same_name wants a token of five letters, of which one may be left out
    first = full.select("*", F.posexplode("t").alias("i", "x")).where(F.length(letters("x")) >= 4)
    two = first.select("s", "many", "x", "i", F.posexplode("t").alias("j", "y")).where("i <> j").select("s", "many", F.col("x").alias("t"), (F.length(letters("x")) >= 5).alias("long"), letters("y").alias("o"))
    if own:
        keys = "concat(transform(sequence(1, greatest(1, length(o) - 1)), k -> if(k < length(o), concat('c', substr(o, 1, k)), null)), transform(sequence(2, greatest(2, length(o))), k -> if(k <= length(o), concat('k', substr(o, 1, k)), null)))"
    else:
        endings = ", ".join(f"'{e}'" for e in names.PETS)
        keys = f"concat(array(concat('c', o)), transform(filter(array({endings}), e -> endswith(o, e) and length(o) - length(e) >= 2), e -> concat('k', substr(o, 1, length(o) - length(e)))))"
    return two.select("s", "many", "t", "long", F.explode(F.array_compact(F.expr(keys))).alias("k"), F.length("o").alias("size"))


def _levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        level = [names.same_name(names.parted(n)[1], names.parted(m)[1]) for n, m in zip(b.n, b.n2)]
        yield b.assign(level=level)[["s", "s2", "level"]].query("level > 0")


def numbered(spelt: DataFrame) -> DataFrame:
    """(s, n): the distinct names n of spelt with a number each, written."""
    return save(spelt.select("n").distinct().withColumn("s", F.monotonically_increasing_id()).select("s", "n"))


def fitting_names(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((n, n2, level), (t, t2)): fitting_numbers with the names themselves."""
    ln = numbered(left)
    rn = ln if left is right else numbered(right)
    fits, near = fitting_numbers(ln, rn)
    return fits.join(ln, "s").join(rn.select(F.col("s").alias("s2"), F.col("n").alias("n2")), "s2").select("n", "n2", "level"), near


def fitting_numbers(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((s, s2, level), (t, t2)): the numbers of all names (s, n) of both sides that fit (level of
    names.same_name; lone ones: 2), and their tokens that are one word.  If both sides are one
    table, pairs of level 1 come once, in either order.

    Tokens are compared once per distinct token, names once per distinct name.  Names meet by two
    tokens each time, both near, or one near and the other shortened, so no token is too common
    or too short to be used and blocks hold names that fit.  Names of two tokens need no further
    comparison; those of more, however many, are compared as a whole.  Only numbers are joined and
    grouped until then."""
    ln, rn = parts_of(left), parts_of(right)
    # joined by merging: it is used in many joins at once, and each broadcast would pass through the driver
    near = save(near_tokens(*(x.select(F.explode("t").alias("t")) for x in (ln, rn)))).hint("merge")
    lone = ln.where("kind = 'N'").select("s", F.col("t")[0].alias("t")).join(near, "t").join(rn.where("kind = 'N'").select(F.col("s").alias("s2"), F.col("t")[0].alias("t2")), "t2").select("s", "s2", F.lit(2).alias("level"))
    lf, rf = (x.where("kind <> 'N'").select("s", "t", (F.size("t") > 2).alias("many")) for x in (ln, rn))
    lp, rp = token_pairs(lf), token_pairs(rf)
    x_near, y_near = near.select(F.col("t").alias("x"), F.col("t2").alias("x2")), near.select(F.col("t").alias("y"), F.col("t2").alias("y2"))
    pair = lambda p, q: F.array_sort(F.array(p, q)).alias("both")
    both = lp.join(x_near, "x").join(y_near, "y").select("s", "many", pair("x2", "y2"))
    both = both.join(rp.select(F.col("s").alias("s2"), F.col("many").alias("many2"), pair("x", "y")), "both").select("s", "s2", (F.col("many") | F.col("many2")).alias("many"), F.lit(2).alias("level"))

    def shortened(short: DataFrame, whole: DataFrame, a: str, b: str) -> DataFrame:
        """Names a of short of which a token is near one of b and another shortens one of b."""
        s = sides(short, own=False).join(near if a == "s" else near.select(F.col("t2").alias("t"), F.col("t").alias("t2")), "t")
        w = sides(whole, own=True).select(F.col("s").alias("w"), F.col("many").alias("many2"), F.col("t").alias("t2"), F.col("long").alias("long2"), "k", F.col("size").alias("size2"))
        # a shortened form may be a letter longer than the whole
        return s.join(w, ["t2", "k"]).where("(long or long2) and size < size2 + 2").select(F.col("s").alias(a), F.col("w").alias(b), (F.col("many") | F.col("many2")).alias("many"), F.lit(1).alias("level"))

    # each written by itself: one plan of all would hold its shuffles and its state in the driver until the last is done
    parts = [both, shortened(lf, rf, "s", "s2")] + ([] if left is right else [shortened(rf, lf, "s2", "s")])
    parts = [save((x.where("s <> s2") if left is right else x).distinct()) for x in parts]
    met = save(reduce(DataFrame.unionByName, parts).groupBy("s", "s2", "many").agg(F.max("level").alias("level")))
    discard(*parts)
    second = right.select(F.col("s").alias("s2"), F.col("n").alias("n2"))
    many = spread_rows(met.where("many").join(left, "s").join(second, "s2").select("s", "s2", "n", "n2")).mapInPandas(_levels, "s long, s2 long, level int")
    same = left.where("n not like 'N%'").join(second, left.n == second.n2).select("s", "s2", F.lit(2).alias("level"))
    return reduce(DataFrame.unionByName, [lone, same, met.where("not many").select("s", "s2", "level"), many]), near


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): ids with names that fit, or with a whole birth date and a token of five letters in common."""
    ls, rs = save(_spelt(left)), save(_spelt(right))
    ln, rn = numbered(ls), numbered(rs)
    fits, near = fitting_numbers(ln, rn)
    # each written by itself here too, so that the driver holds the shuffles of no more than one at a time
    fits = save(fits.select("s", "s2"))
    by_name = save(
        fits.join(ls.join(ln, "n").select(F.col("id").alias("a"), "s"), "s")
        .join(rs.join(rn, "n").select(F.col("id").alias("b"), F.col("s").alias("s2")), "s2")
        .select("a", "b")
    )

    def born(people: DataFrame, spelt: DataFrame) -> DataFrame:
        t = parts_of(spelt).select("id", F.explode("t").alias("t")).where(F.length(F.substring_index("t", "=", 1)) >= 5)
        return t.join(people.select("id", F.explode("births").alias("born")).where("length(born) = 10"), "id").distinct()

    lb, rb = born(left, ls), born(right, rs)
    by_birth = save(lb.join(near, "t").select(F.col("id").alias("a"), "t2", "born").join(rb.select(F.col("id").alias("b"), F.col("t").alias("t2"), "born"), ["t2", "born"]).select("a", "b"))
    found = save(by_name.unionByName(by_birth).distinct())
    discard(fits, by_name, by_birth, ls, rs, ln, rn)
    return found


def _birth(x: str) -> tuple[int, int, int, bool]:
    """(year, month, day, about): 0 where not stated."""
    about = x.startswith("~")
    y, m, d = (int(v) for v in (x.lstrip("~") + "-0-0").split("-")[:3])
    return y, m, d, about


def compare_births(left: list[str], right: list[str]) -> list[float]:
    """The birth features: the best agreement of any two statements."""
    day = month = year = swapped = digit = same_year = conflict = 0.0
    if not left or not right:
        return [0, 0, 0, 0, 0, 0, 0, 1]
    for x in left:
        for z in right:
            a, b = _birth(x), _birth(z)
            if abs(a[0] - b[0]) > (2 if a[3] or b[3] else 0):
                full = a[1] and b[1] and a[2] and b[2]
                if full and sum(p != q for p, q in zip(x, z)) == 1 and len(x) == len(z):
                    digit = 1.0
                continue
            if a[1] and b[1] and a[2] and b[2]:
                if a[:3] == b[:3]:
                    day = 1.0
                elif a[0] == b[0] and (a[1], a[2]) == (b[2], b[1]):
                    swapped = 1.0
                elif a[0] == b[0] and len(x) == len(z) and sum(p != q for p, q in zip(x, z)) == 1:
                    digit = 1.0
                elif a[0] == b[0]:
                    same_year = 1.0
            elif a[1] and b[1]:
                month = max(month, float(a[1] == b[1]))
                same_year = max(same_year, float(a[1] != b[1]))
            else:
                year = 1.0
    if day:
        month = year = swapped = digit = same_year = 0.0
    conflict = float(not (day or month or year or swapped or digit or same_year))
    return [day, month, year, swapped, digit, same_year, conflict, 0.0]


def _rest(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Of names with one word in common, the best ratio of two others of their words."""
    shared = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if names.same_token(x, y)]
    if not shared:
        return 0.0
    ratios = sorted(((names.lcs_ratio(names.folded(p), names.folded(q)), k, m) for k, p in enumerate(a) for m, q in enumerate(b)), reverse=True)
    return max(next((r for r, k, m in ratios if k != i and m != j), 0.0) for i, j in shared)


def pair_features(names_a, births_a, country_a, names_b, births_b, country_b) -> list[float]:
    full = short = nick = rest = ratio = 0.0
    for n in names_a if names_a is not None else ():
        ka, ta = names.parted(n)
        for m in names_b if names_b is not None else ():
            kb, tb = names.parted(m)
            if (ka == "N") != (kb == "N"):
                continue
            if ka == "N":
                nick = max(nick, float(names.same_token(ta[0], tb[0])))
                continue
            level = names.same_name(ta, tb)
            full, short = max(full, float(level == 2)), max(short, float(level == 1))
            rest = max(rest, 1.0 if level else _rest(ta, tb))
            ratio = max(ratio, names.lcs_ratio("".join(map(names.folded, ta)), "".join(map(names.folded, tb))))
    short = short * (1 - full)
    same = country_a is not None and country_b is not None
    eq = same and country_a.strip().lower() == country_b.strip().lower()
    births_a = [] if births_a is None else [x for x in births_a if x]
    births_b = [] if births_b is None else [x for x in births_b if x]
    return [full, short, nick, rest, ratio, *compare_births(births_a, births_b), float(eq), float(same and not eq)]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 0.3, rounds: int = 40) -> np.ndarray:
    """Weights (the last is the constant) by Newton steps on the penalised likelihood of weighted rows."""
    z = np.hstack([x, np.ones((len(x), 1))])
    v = np.ones(len(x)) if weight is None else weight
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (v * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (v * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit_calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, float, float] | None:
    """(weights, scale, shift): fitted on two thirds, the probabilities calibrated on the rest; None
    unless there are rows of both kinds to learn from."""
    weight = np.ones(len(x)) if weight is None else weight
    held = np.arange(len(x)) % 3 == 2
    if len(np.unique(y[~held])) < 2:
        return None
    w = fit_logistic(x[~held], y[~held], weight[~held])
    s = np.hstack([x[held], np.ones((held.sum(), 1))]) @ w
    if len(np.unique(y[held])) < 2:
        return w, 1.0, 0.0
    scale, shift = fit_logistic(s[:, None], y[held], weight[held], ridge=1.0)
    return (w, float(scale), float(shift)) if scale > 0 else (w, 1.0, 0.0)


_FEATURE_SCHEMA = "a string, b string, f array<double>"


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        f = [pair_features(*r) for r in zip(b.na, b.ba, b.ca, b.nb, b.bb, b.cb)]
        yield pd.DataFrame({"a": b.a, "b": b.b, "f": f})


def featured(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    la = left.select(F.col("id").alias("a"), F.col("names").alias("na"), F.col("births").alias("ba"), F.col("country").alias("ca"))
    rb = right.select(F.col("id").alias("b"), F.col("names").alias("nb"), F.col("births").alias("bb"), F.col("country").alias("cb"))
    return spread_rows(pairs.select("a", "b").join(la, "a").join(rb, "b")).mapInPandas(_features, _FEATURE_SCHEMA)


def _at(feature: str) -> F.Column:
    return F.col("f")[FEATURES.index(feature)]


def match(left: DataFrame, right: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, confidence, grounds) of pairs of left and right (see with_names) with probability of at least THRESHOLD.

    labels (a, b, y): reviewed pairs, of which up to LABELS (by a fixed hash) train the
    classifier, beside up to WEAK candidates each that agree in a whole name and in the birth
    date (taken as one person) or contradict in the latter (taken as two).  Records without a
    name match nothing; repeated ids count once; where neither labels nor data give examples
    of both kinds, nothing can be learnt and there are no rows.
    """
    left, right = save(with_names(left.dropDuplicates(["id"]))), save(with_names(right.dropDuplicates(["id"])))
    reviewed = labels.where("a is not null and b is not null and y is not null").dropDuplicates(["a", "b"]).orderBy(F.xxhash64("a", "b")).limit(LABELS)
    # a birth date and one word are shared by chance too: candidates by them need another word that is alike
    scored = save(featured(candidates(left, right), left, right).where((_at("name_full") + _at("name_short") + _at("nickname") > 0) | (_at("rest") >= REST)))
    some = lambda rows, y: rows.orderBy(F.xxhash64("a", "b")).limit(WEAK).select("a", "b", "f", F.lit(y).alias("y"), F.lit(WEAK_WEIGHT).alias("weight"))
    full = scored.where(_at("name_full") > 0)
    train = (
        featured(reviewed, left, right).join(reviewed, ["a", "b"]).select("a", "b", "f", "y", F.lit(1.0).alias("weight"))
        .unionByName(some(full.where(_at("birth_day") > 0), True)).unionByName(some(full.where(_at("birth_conflict") > 0), False))
    ).toPandas().sort_values(["weight", "a", "b"])  # fmt: skip  # at most LABELS + 2 WEAK rows
    x = np.array(train.f.tolist(), float).reshape(len(train), len(FEATURES))
    fitted = fit_calibrated(x, train.y.to_numpy(float), train.weight.to_numpy(float))
    if fitted is None:
        return scored.select("a", "b", F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("grounds")).limit(0)
    w, scale, shift = fitted
    logit = sum((F.col("f")[k] * float(v) for k, v in enumerate(w[:-1])), F.lit(float(w[-1])))
    p = 1 / (1 + F.exp(-(logit * scale + shift)))
    on = lambda *names_: reduce(lambda c, d: c | d, [_at(n) > 0 for n in names_])
    grounds = F.array_compact(
        F.array(
            F.when(on("name_full", "name_short"), "name"), F.when(on("nickname"), "alias"),
            F.when(on("birth_day", "birth_month", "birth_year"), "birthDate"), F.when(on("country_same"), "country"),
        )
    )
    return scored.select("a", "b", F.round(p, 6).alias("confidence"), grounds.alias("grounds")).where(F.col("confidence") >= THRESHOLD)


def _id_birth(c: str) -> F.Column:
    """The birth date in a national id: yymmdd after two letters, 20 added to the month from 2000 on."""
    d = F.regexp_extract(F.regexp_replace(F.col(c), r"[^\p{L}\p{N}]", ""), r"^\p{L}{2}(\d{6})\d{2}$", 1)
    yy, mm, dd = (F.substring(d, k, 2).try_cast("int") for k in (1, 3, 5))
    text = F.concat_ws("-", F.when(mm > 20, yy + 2000).otherwise(yy + 1900).cast("string"), F.lpad(F.when(mm > 20, mm - 20).otherwise(mm).cast("string"), 2, "0"), F.lpad(dd.cast("string"), 2, "0"))
    return F.when(d != "", text.try_cast("date").cast("string"))


def suspects_as_people(suspects: DataFrame, systems: DataFrame) -> DataFrame:
    s = suspects.join(F.broadcast(systems.select(F.col("code").alias("dobSource"), "dateorder")), "dobSource", "left")
    dob = F.date_from_unix_date(read_birth(F.col("dateOfBirth"), F.col("dateorder"))).cast("string")
    births = F.array_compact(F.array_distinct(F.array(dob, _id_birth("nationalId"))))
    return s.select(F.col("id").cast("string").alias("id"), F.col("fullName").alias("name"), "aliases", F.lit(None).cast("array<string>").alias("listed"), births.alias("births"), "country")


def entries_as_people(entries: DataFrame) -> DataFrame:
    b = F.lower(F.trim("birthDate"))
    text = F.when(b.rlike(r"^\d{4}(-\d{2}){0,2}$"), b).when(b.rlike(r"\d{4}$") & b.rlike(r"^[a-z.~ ]+\d{4}$"), F.concat(F.lit("~"), F.substring(b, -4, 4)))
    text = F.coalesce(text, F.date_from_unix_date(read_birth(F.col("birthDate"), F.lit("DMY"), 1850, 2100)).cast("string"))
    listed = F.concat(F.coalesce("names", F.array()), F.coalesce("aliases", F.array()), F.array_compact(F.array("caption")))
    return entries.where("schema is null or schema = 'Person'").select(
        "id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("aliases"), listed.alias("listed"), F.array_compact(F.array(text)).alias("births"), "country"
    )


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(suspectid, entryid, confidence, matchedby) of matched pairs."""
    people = suspects_as_people(table(spark, sf_dir, "suspects"), table(spark, sf_dir, "source_systems"))
    entries = entries_as_people(table(spark, sf_dir, "sanctions_entries"))
    labels = table(spark, sf_dir, "match_labels").select(F.col("suspectid").cast("string").alias("a"), F.col("entryid").alias("b"), F.col("ismatch").alias("y"))
    found = match(people, entries, labels)
    return found.select(F.col("a").cast("long").alias("suspectid"), F.col("b").alias("entryid"), "confidence", F.col("grounds").alias("matchedby"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_matches(spark, sf_dir).select("suspectid", "entryid")
