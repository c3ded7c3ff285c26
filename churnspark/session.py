"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import SparkSession

Kept = TypeVar("Kept")

#: Settings the engine relies on; everything else stays with the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole texts travel in Arrow batches: bound them by rows and by bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench. On a cluster, use the session it gives you."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("churnspark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Applications that have the package.
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that Python functions can be loaded there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    with tempfile.NamedTemporaryFile(prefix="churnspark-", suffix=".zip", delete=False) as file:
        with zipfile.ZipFile(file, "w") as archive:
            for path in sorted(root.rglob("*.py")):
                archive.write(path, Path(root.name) / path.relative_to(root))
    context.addPyFile(file.name)
    _SHIPPED.add(context.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings that may be changed at run time and send the package to the executors."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


#: Local-mode fallback folders, by application.
_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for written tables and checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode session,
    where driver and executors share one machine, may fall back to a fresh
    temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="churnspark-")
    return _LOCAL_DIRS[context.applicationId]


#: Paths handed out, by application: those that ``release`` deletes, and those of kept values.
_WRITTEN: dict[str, list[str]] = {}
_KEPT_PATHS: dict[str, list[str]] = {}
#: Values that are made once per application, by key; and how many of them are being made.
_KEPT: dict[str, dict[tuple, tuple]] = {}
_MAKING = 0


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (_KEPT_PATHS if _MAKING else _WRITTEN).setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _files_of(spark: SparkSession, path: str):
    """(file system, path) of a path in any store that Spark reaches."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()), target


#: Classes that Spark opens ``file:`` paths by; Hive's, if its jars are there, passes every call on to the first.
LOCAL_STORES = {"org.apache.hadoop.fs.LocalFileSystem", "org.apache.hadoop.hive.ql.io.ProxyLocalFileSystem"}


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path as Python opens it if it lies in a plain local file system, else None."""
    store, target = _files_of(spark, path)
    if store.getUri().getScheme() != "file" or store.getClass().getName() not in LOCAL_STORES:
        return None
    return store.makeQualified(target).toUri().getPath()


def kept(spark: SparkSession, key: tuple, make: Callable[[], Kept]) -> Kept:
    """``make()``, called once per application and key. Tables that it writes outlive ``release``, unless that is told
    to forget them, so an index or a graph is written once and read by every query of a session. If someone else has
    deleted one of these tables, the value is made again."""
    global _MAKING
    application = spark.sparkContext.applicationId
    held, paths = _KEPT.setdefault(application, {}), _KEPT_PATHS.setdefault(application, [])
    if key in held:
        value, written = held[key]
        if all(store.exists(path) for store, path in (_files_of(spark, p) for p in written)):
            return value
    _MAKING += 1
    before = len(paths)
    try:
        value = make()
    finally:
        _MAKING -= 1
    held[key] = value, tuple(paths[before:])
    return value


def version(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files under a path: another version of a table has another."""
    store, target = _files_of(spark, path)
    files, found = store.listFiles(target, True), []
    while files.hasNext():
        file = files.next()
        found.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return tuple(sorted(found))


def release(spark: SparkSession, kept_too: bool = False) -> None:
    """Delete the intermediate tables written so far, with ``kept_too`` also those of kept values. Call it when results
    have been written or collected: DataFrames that read such a table cannot be run again."""
    application = spark.sparkContext.applicationId
    paths = _WRITTEN.pop(application, [])
    if kept_too:
        paths += _KEPT_PATHS.pop(application, [])
        _KEPT.pop(application, None)
    for store, path in (_files_of(spark, p) for p in paths):
        store.delete(path, True)


def materialize(df, label: str):
    """Write ``df`` once and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
