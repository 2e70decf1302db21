"""Problem 4: pairing records of two tables by nearest time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moneytrail.plans.session import save, table, tasks_for

ROWS_PER_TASK = 150_000  # rows of both sides that one co-group holds, on average
HOT = 1_000_000  # rows of one entity and range, of either side, from which it is cut further
CUTS = 256  # time ranges into which such a range is cut
WINDOW_S = 6 * 3600  # length of a time range; records near its ends are also put in the next one


def _nearest(left: pd.DataFrame, right: pd.DataFrame, tolerance_us: int) -> pd.DataFrame:
    """For each left row the right row of its cell (entity, range) that is nearest in time."""
    empty = pd.DataFrame({"left_id": np.array([], "int64"), "right_id": np.array([], "int64")})
    if left.empty or right.empty:
        return empty
    # one order over (entity, range, time): cells become ranks, times are compared inside them
    cells, inverse = np.unique(np.concatenate([left.entity.to_numpy(), right.entity.to_numpy()]), return_inverse=True)
    lr = np.stack([inverse[: len(left)], left.span.to_numpy()])
    rr = np.stack([inverse[len(left) :], right.span.to_numpy()])
    both, rank = np.unique(np.concatenate([lr, rr], axis=1), axis=1, return_inverse=True)
    rank = rank.reshape(-1)
    lc, rc = rank[: len(left)], rank[len(left) :]
    lt, rt = left.us.to_numpy(), right.us.to_numpy()
    low = min(lt.min(), rt.min())
    wide = int(max(lt.max(), rt.max()) - low) + 2 * tolerance_us + 2
    # rank * wide must fit into 63 bits: count time from the start of each cell's range
    start = both[1] * (WINDOW_S * 1_000_000)
    if wide > 4 * WINDOW_S * 1_000_000:
        wide = (WINDOW_S + 1) * 1_000_000 + 4 * tolerance_us
        lk = lc * wide + (lt - start[lc]) + 2 * tolerance_us
        rk = rc * wide + (rt - start[rc]) + 2 * tolerance_us
    else:
        lk, rk = lc * wide + (lt - low), rc * wide + (rt - low)
    order = np.lexsort((right.id.to_numpy(), rk))
    rk, rc, rid = rk[order], rc[order], right.id.to_numpy()[order]
    keep = np.concatenate([[True], rk[1:] != rk[:-1]])  # of equal times the least id
    rk, rc, rid = rk[keep], rc[keep], rid[keep]
    at = np.searchsorted(rk, lk, side="left")
    far = np.int64(2**62)
    before, after = np.maximum(at - 1, 0), np.minimum(at, len(rk) - 1)
    d0 = np.where((at > 0) & (rc[before] == lc), lk - rk[before], far)
    d1 = np.where((at < len(rk)) & (rc[after] == lc), rk[after] - lk, far)
    best = np.where((d0 < d1) | ((d0 == d1) & (rid[before] < rid[after])), before, after)
    ok = np.minimum(d0, d1) <= tolerance_us
    return pd.DataFrame({"left_id": left.id.to_numpy()[ok], "right_id": rid[best[ok]]})


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance_s: int) -> DataFrame:
    """(left_id, right_id): for each row of left (id, entity, us) the row of right of the same
    entity whose time is nearest, if at most tolerance_s away; ties take the least right id.

    Both sides are cut into ranges of WINDOW_S per entity; a right row also goes into the
    neighbouring range where that lies within the tolerance, so each left row meets all its
    candidates in its own range.  Ranges are hashed over co-groups of bounded size: an entity
    with a third of all rows spreads over as many tasks as its time span has ranges.  Of right
    rows at one instant only the least id is kept; a range with more than HOT rows of either
    side is cut further, see _cut.  Rows without entity or time match nothing; repeated rows
    count as rows; empty tables give no pairs; further columns are ignored.
    """
    spark = left.sparkSession
    tolerance_us, window_us = tolerance_s * 1_000_000, WINDOW_S * 1_000_000
    if tolerance_us > window_us:
        raise ValueError("the tolerance must not exceed the length of a range")
    spans = F.expr(f"array_distinct(array(us div {window_us}, (us - {tolerance_us}) div {window_us}, (us + {tolerance_us}) div {window_us}))")
    lt = left.where("entity is not null and us is not null").select("id", "entity", "us", F.expr(f"us div {window_us}").alias("span"))
    rt = right.where("entity is not null and us is not null").select("id", "entity", "us", F.explode(spans).alias("span"))
    rt = rt.groupBy("entity", "us", "span").agg(F.min("id").alias("id"))
    one, none = F.lit(1), F.lit(0)
    sizes = lt.select("entity", "span", one.alias("l"), none.alias("r")).unionByName(rt.select("entity", "span", none.alias("l"), one.alias("r")))
    ranges = save(sizes.groupBy("entity", "span").agg(F.sum("l").alias("l"), F.sum("r").alias("r")))
    rows, hot = ranges.agg(F.coalesce(F.sum(F.col("l") + F.col("r")), F.lit(0)), F.count_if(F.greatest("l", "r") > HOT)).first()
    if hot:
        lt, rt = _cut(lt, rt, ranges.where(F.greatest("l", "r") > HOT))
    else:
        lt, rt = lt.withColumn("part", F.lit("")), rt.withColumn("part", F.lit(""))
    cell = F.pmod(F.xxhash64("entity", "span", "part"), F.lit(tasks_for(rows, ROWS_PER_TASK, spark))).cast("int").alias("cell")
    lt, rt = (x.select("id", "entity", "us", "span", cell) for x in (lt, rt))
    return (
        lt.groupBy("cell")
        .cogroup(rt.groupBy("cell"))
        .applyInPandas(lambda a, b: _nearest(a, b, tolerance_us), "left_id long, right_id long")
    )


def _cut(left: DataFrame, right: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the part of their range (entity, span): '' but for the hot ones.

    A hot range is cut at quantiles of its right times, so that a part holds few right rows however
    they bunch; each part also gets the last right row before it and the first after it, which
    is all that its left rows can need from elsewhere.  Many left rows in one part (they may
    share an instant) are cut by their id, each with the part's right rows."""
    key = ["entity", "span"]
    cuts = right.join(hot.select(*key), key, "left_semi").groupBy(*key).agg(F.percentile_approx("us", [k / CUTS for k in range(1, CUTS)], 10_000).alias("cuts"))
    cuts = save(hot.select(*key).join(cuts, key, "left"))
    sub = F.when(F.col("hot"), F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("us"))), F.lit(0)))
    placed = lambda side: side.join(cuts.withColumn("hot", F.lit(True)), key, "left").withColumn("sub", sub).drop("cuts", "hot")
    lt, rt = placed(left), placed(right)
    ends = rt.where("sub is not null").groupBy(*key, "sub").agg(F.min(F.struct("us", "id")).alias("lo"), F.max(F.struct("us", "id")).alias("hi"))
    spine = cuts.select(*key, F.explode(F.sequence(F.lit(0), F.lit(CUTS - 1))).alias("sub")).join(ends, [*key, "sub"], "left")
    w = Window.partitionBy(*key).orderBy("sub")  # CUTS rows
    before = F.last("hi", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("lo", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    spine = spine.select(*key, "sub", F.array(before, after).alias("ends"))
    near = spine.select(*key, "sub", F.explode(F.array_compact("ends")).alias("e")).select("e.id", "entity", "e.us", "span", "sub")
    rt = rt.unionByName(near)
    many = lt.where("sub is not null").groupBy(*key, "sub").agg(F.ceil(F.count("*") / HOT).cast("int").alias("k"))
    part = lambda n: F.coalesce(F.concat_ws("-", F.col("sub").cast("string"), n.cast("string")), F.lit(""))
    lt = lt.join(many, [*key, "sub"], "left").withColumn("part", F.when(F.col("sub").isNull(), "").otherwise(part(F.pmod(F.xxhash64("id"), F.col("k")))))
    rt = rt.join(many, [*key, "sub"], "left").withColumn("n", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)))
    return lt, rt.withColumn("part", F.when(F.col("sub").isNull(), "").otherwise(part(F.col("n"))))


def micros(c: str) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def p4_found(spark: SparkSession, sf_dir: str, tolerance_s: int = 1800) -> DataFrame:
    """(txnid, callid): each transaction's nearest call of the same suspect within half an hour."""
    owners = table(spark, sf_dir, "bank_accounts").where("suspectId is not null").select(F.col("id").alias("bankAccountId"), F.col("suspectId").alias("entity"))
    txns = table(spark, sf_dir, "bank_transactions").select("id", "bankAccountId", micros("timestamp").alias("us")).join(owners, "bankAccountId")
    calls = table(spark, sf_dir, "call_records").select("id", F.col("suspectId").alias("entity"), micros("startTime").alias("us"))
    found = nearest_in_time(txns.select("id", "entity", "us"), calls, tolerance_s)
    return found.select(F.col("left_id").alias("txnid"), F.col("right_id").alias("callid"))
