"""Loading tables, staging intermediate tables, session defaults."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    global _local_dir
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return _local_dir


def work_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it is deleted when the driver's Python ends, or by purge()."""
    app = spark.sparkContext.applicationId
    if app not in _cleaned:
        _cleaned.add(app)
        atexit.register(_end, spark)
    return f"{shared_dir(spark)}/spanloom/{app}"


_cleaned: set[str] = set()


def _end(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            purge(spark)
    except Exception:  # the JVM is gone: the folder stays for whoever looks after the shared one
        pass


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors.

    Needed before an iterative step, and where two later branches would otherwise repeat Python work. Shuffle files of
    the write are deleted at its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    for paths in _within:
        paths.append(path)
    return out


_within: list[list[str]] = []


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Delete at the end of the block the tables staged in it; what is kept of them has been read by then."""
    _within.append(paths := [])
    try:
        yield
    finally:
        _within.pop()
        for path in paths:
            _delete(spark, path)


def discard(*staged: DataFrame) -> None:
    """Delete tables as stage() returned them, once everything that reads them has been written."""
    for df in staged:
        _delete(df.sparkSession, df._staged)


def spread(df: DataFrame, least: int = 2) -> DataFrame:
    """Give a table read from few files at least one partition per core, so that Python work is shared out.

    A scan in as many partitions or more is left alone, as at scale; so is a plan with a shuffle, whose number of
    partitions is known only once it has run.
    """
    if getattr(df, "_jdf", None) is None or "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df  # a remote session has no plan to look at
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least * n) if df.rdd.getNumPartitions() < n else df


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by keys for a grouping that Python work follows: as many partitions as the session's shuffles or
    twice the cores, not merged into few when the table is small. The grouping needs no further shuffle."""
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def purge(spark: SparkSession) -> None:
    """Delete the staged tables of this application, and no other's; call it when their results have been written."""
    _delete(spark, f"{shared_dir(spark)}/spanloom/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
