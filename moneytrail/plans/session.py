"""Session, table reading and tables written to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
import time
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = "*", app: str = "moneytrail", **extra: str) -> SparkSession:
    """A local session with the settings the library is tuned for; on a cluster use its own."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | extra
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ROOTS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: below spark.checkpoint.dir.  Only a session on one machine may
    leave that unset and gets a temporary folder; on a cluster an unset one is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + _ROOTS.setdefault("own", tempfile.mkdtemp(prefix="moneytrail-"))
    key = f"{spark.sparkContext.applicationId}:{base}"
    if key not in _ROOTS:
        _ROOTS[key] = f"{base.rstrip('/')}/moneytrail-{uuid.uuid4().hex[:12]}"
    return _ROOTS[key]


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path of any scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


@atexit.register
def _clean() -> None:
    for path in _ROOTS.values():
        local = urlparse(path)
        if local.scheme in ("", "file"):
            shutil.rmtree(local.path, ignore_errors=True)
        else:
            with contextlib.suppress(Exception):  # the session may have ended already
                remove(SparkSession.getActiveSession(), path)


FREE_EVERY = 5  # seconds between two collections by save()
_freed = [0.0]


def free(spark: SparkSession) -> None:
    """Let go of plans, broadcasts and shuffle files of queries that are over: Spark drops them only when
    both collectors find them, and till then the driver's heap grows and the files stay."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _freed[0] = time.monotonic()


def save(df: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors.

    Unlike checkpoint() the plan runs once and the reader knows the size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    w = df.write.mode("error")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._moneytrail_path = path
    if time.monotonic() - _freed[0] > FREE_EVERY:
        free(spark)
    return back


def together(parts: list[DataFrame]) -> DataFrame:
    """Tables of one schema written by save(), read as one scan."""
    first = parts[0]
    return first.sparkSession.read.schema(first.schema).parquet(*(p._moneytrail_path for p in parts))


def written_bytes(df: DataFrame) -> int:
    """Size of the files of a table written by save()."""
    fs, p = file_system(df.sparkSession, df._moneytrail_path)
    return fs.getContentSummary(p).getLength()


def discard(*tables: DataFrame) -> None:
    """Delete tables written by save() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_moneytrail_path", None)
        if path:
            remove(df.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """A scan in at least as many tasks as there are cores: a table of one small file would else
    keep one core busy.  Larger tables have more splits than that and aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tasks_for(rows: int, per_task: int, spark: SparkSession) -> int:
    """Partitions so that each holds about per_task rows, at least the shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def local_path(path: str) -> str:
    return os.path.abspath(urlparse(path).path)
