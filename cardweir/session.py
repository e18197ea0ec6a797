"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs rely on. Partition counts are left to the cluster's own configuration: AQE
# coalesces small shuffles, and a 100 TB run sets spark.sql.shuffle.partitions for its executors.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cpus: str = "8", memory: str = "8g", app: str = "cardweir") -> SparkSession:
    """A session for tests and the bench; on a cluster use the session you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    """All calendar parts are UTC; pin it on whatever session the caller brought."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_LOCAL_SHARED: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    Only a session on a local master may do without that setting: all its tasks share one machine, and a
    fresh temporary folder is used, deleted at exit. Elsewhere each executor would write to its own disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL_SHARED:
        _LOCAL_SHARED["dir"] = tempfile.mkdtemp(prefix="cardweir-")
        atexit.register(shutil.rmtree, _LOCAL_SHARED["dir"], ignore_errors=True)
    return _LOCAL_SHARED["dir"]


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders right below a folder; none if it is not there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_WRITTEN: list[tuple[SparkSession, str]] = []


def release_tables() -> None:
    """Delete the tables written by this process; its lazy results can't be read afterwards."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001  the session has ended: nothing can be reached any more
            return


atexit.register(release_tables)


def new_table_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder; what is written there goes when the process ends."""
    path = _new_path(spark, label)
    _WRITTEN.append((spark, path))
    return path


def _new_path(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_dir(spark), "cardweir", f"{label}-{uuid.uuid4().hex}")


#: Spark deletes an execution's shuffle files at its end where this is on, else when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves no shuffle files behind, so the disk holds those of one step at a time."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


@contextlib.contextmanager
def passing_tables() -> Iterator[Callable]:
    """Tables that are written in here are deleted at the end of the block, but for those it is asked to keep (tables of ``materialise`` or paths)."""
    first, kept = len(_WRITTEN), []

    def keep(table):
        kept.append(table if isinstance(table, str) else table._written_at)
        return table

    try:
        yield keep
    finally:
        passing, _WRITTEN[first:] = _WRITTEN[first:], [w for w in _WRITTEN[first:] if w[1] in kept]
        for spark, path in passing:
            if path not in kept:
                delete_path(spark, path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Used where a later step reads a result several times and must see the very same rows each
    time, and to cut the lineage of iterative jobs. A lost executor re-reads files instead of
    recomputing. The shuffles behind it are over by then, and so are their files.
    """
    spark = df.sparkSession
    path = new_table_path(spark, label)
    with freed_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote and nothing reads any more."""
    path = getattr(table, "_written_at", None)
    if path is not None:
        delete_path(table.sparkSession, path)
