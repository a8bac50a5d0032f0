"""Sessions, table reading and the scratch tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None
_roots: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(cores: int = 8, shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("claimloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once, so that they need no path of their own.

    The archive is made in the session's own file folder on the driver, from
    which Spark serves it to all executors.
    """
    from pyspark import SparkFiles

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = os.path.join(SparkFiles.getRootDirectory(), "build")
    os.makedirs(folder, exist_ok=True)
    archive = os.path.join(folder, "claimloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(at, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_fs(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_fs(spark, path)
    return fs.getFileStatus(p).isFile()


def remove_path(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop_fs(spark, path)
    fs.delete(p, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in spark.checkpoint.dir; only where that is unset, as
    in tests on one machine, a folder of this process is made and set.
    """
    global _local_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None or not os.path.isdir(_local_dir):
        _local_dir = tempfile.mkdtemp(prefix="claimloom-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(_local_dir)
    return _local_dir


def _root(spark: SparkSession) -> str:
    """The application's own folder below the shared one, named after it, so that one whose driver was killed can be told and removed."""
    key = spark.sparkContext.applicationId
    if key not in _roots:
        _roots[key] = f"{shared_dir(spark)}/claimloom-{key}-{uuid.uuid4().hex}"
        atexit.register(_drop_root, spark, _roots[key])
    return _roots[key]


def _drop_root(spark: SparkSession, root: str) -> None:
    try:
        fs, p = _hadoop_fs(spark, root)
        fs.delete(p, True)
    except Exception:
        pass  # the session has ended before; the folder goes with the checkpoint folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the application's own folder, for what is written and read as files."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's switch by which a statement deletes its shuffle files at its end. Else they stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch_scope() -> Iterator[Callable[..., DataFrame | None]]:
    """A stretch of work whose scratch tables are deleted at its end, but for those it keeps.

    Gives a function that keeps tables (for the scope around this one, if any)
    and returns the first. A result that is read later must be a kept table, or
    made of kept tables only.
    """
    mine: list[DataFrame] = []
    kept: list[str] = []

    def keep(*dfs: DataFrame) -> DataFrame | None:
        kept.extend(p for p in (getattr(df, "_claimloom_path", None) for df in dfs) if p)
        return dfs[0] if dfs else None

    _scopes.append(mine)
    try:
        yield keep
    finally:
        _scopes.pop()
        for df in mine:
            if df._claimloom_path in kept:
                if _scopes:
                    _scopes[-1].append(df)
            else:
                release(df)


def scratch(df: DataFrame, name: str = "t") -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts lineage the way checkpoint() does, but columnar and compressed, and
    outlives the loss of any executor. What was shuffled for it is deleted with
    its end.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._claimloom_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def release(*dfs: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in dfs:
        path = getattr(df, "_claimloom_path", None)
        if path:
            fs, p = _hadoop_fs(df.sparkSession, path)
            fs.delete(p, True)
