"""Writers. Each writes to a path of its own and returns it, so a rerun never overwrites what is being read."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from churnspark.functions.columns import slug
from churnspark.session import fresh_path, local_path, materialize

# Columns of the at-risk export and their headings.
EXPORT_COLUMNS = {
    "account_name": "Name",
    "segment": "Segment",
    "arr": "ARR",
    "risk_score": "Risk Score",
    "days_until_churn": "Days Until Churn",
    "risk_reason": "Risk Reason",
    "trend": "Trend",
}

CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True}


def write_csv(df: DataFrame, path: str | None = None, by_method: bool = False) -> str:
    """A result table as CSV, in one folder or one folder per ``method`` slug."""
    path = path or fresh_path(df.sparkSession, "csv")
    writer = (df.withColumn("method_slug", slug("method")) if by_method else df).write.mode("overwrite")
    (writer.partitionBy("method_slug") if by_method else writer).options(**CSV_OPTIONS).csv(path)
    return path


#: Files that one task of ``write_text_folder`` writes on average.
TASK_FILES = 2000

#: Folder of rows without a name, and the bytes of a name that are escaped, as Spark's partitioned writers have them.
NO_NAME = b"__HIVE_DEFAULT_PARTITION__"
ESCAPED = re.compile(rb"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def write_text_folder(texts: DataFrame, path: str | None = None) -> str:
    """One text file per row (name, value), the one file of a folder ``name=...``, as the writer names files by task.

    Files cost far more than their bytes, so rows are dealt by number of files, not left to the size of the input. On a
    plain local file system Spark's writer starts a process for every file, checksum and folder to set its mode, so there
    tasks write the same files themselves. In any other store tasks move their own files into place when they commit; the
    driver would move them one after another.
    """
    spark = texts.sparkSession
    path = path or fresh_path(spark, "texts")
    tasks = max(1, -(-texts.count() // TASK_FILES))
    dealt = texts.repartition(tasks, "name")
    root = local_path(spark, path)
    if root is None or os.path.exists(root):  # Spark's writer refuses a path that exists
        writer = dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        writer.partitionBy("name").text(path)
        return path
    os.makedirs(root)
    rows = dealt.select(F.col("name").cast("string").cast("binary").alias("name"), F.col("value").cast("binary").alias("value"))
    files = rows.sortWithinPartitions("name").mapInArrow(_file_writer(os.fsencode(root), uuid.uuid4().hex), "files bigint")
    files.agg(F.sum("files")).collect()
    open(f"{root}/_SUCCESS", "wb").close()
    return path


def _file_writer(root: bytes, label: str):
    """Write rows (name, value), sorted by name, as files under a local folder; the number of files of the task.

    A file is written aside under a hidden name of its attempt and then takes the name that it has in every attempt, so a
    task that runs again or twice leaves each file once and whole.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = b"part-%05d-%s.txt" % (context.partitionId(), label.encode())
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        files = 0
        for key, group in groupby(rows, key=lambda row: row[0] or NO_NAME):
            folder = root + b"/name=" + ESCAPED.sub(lambda m: b"%%%02X" % m[0][0], key)
            aside = b"%s/.%s.%d" % (folder, name, context.taskAttemptId())
            os.makedirs(folder, exist_ok=True)
            with open(aside, "wb") as file:
                for _, value in group:
                    file.write((value or b"") + b"\n")
            os.replace(aside, b"%s/%s" % (folder, name))
            files += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    return write


def export_at_risk(at_risk: DataFrame, path: str | None = None) -> str:
    """The seven export columns under their fixed headings."""
    return write_csv(at_risk.select(*[F.col(c).alias(h) for c, h in EXPORT_COLUMNS.items()]), path)


def replace_collection(points: DataFrame, collection: str, path: str | None = None) -> str:
    """Replace one collection; other collections under the same path stay as they are."""
    path = path or fresh_path(points.sparkSession, "collections")
    (
        points.withColumn("collection", F.lit(collection))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("collection")
        .parquet(path)
    )
    return path


def upsert(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Union of both with the highest version per key; aggregated before the shuffle."""
    both = current.unionByName(changes)
    others = [c for c in both.columns if c != key]
    newest = both.groupBy(key).agg(F.max_by(F.struct(*others), version).alias("_row"))
    return newest.select(key, "_row.*").select(*both.columns)


#: Buckets of a stored collection; a table keeps the number it was written with.
BUCKETS = 64


def _bucketed(points: DataFrame, key: str, buckets: int) -> DataFrame:
    return points.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def store_points(points: DataFrame, key: str, path: str | None = None, buckets: int = BUCKETS) -> str:
    """Write a collection as one folder per hash bucket of the key, the unit that a change rewrites."""
    path = path or fresh_path(points.sparkSession, "points")
    dealt = _bucketed(points, key, buckets).repartition("bucket")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)
    return path


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def upsert_stored(path: str, changes: DataFrame, key: str, version: str, buckets: int = BUCKETS) -> list[int]:
    """Merge changes into a stored collection, the highest version of a key wins; returns the rewritten buckets.

    Only buckets that a change falls into are read, and only they are overwritten; files of the others stay as they are.
    The merged buckets are written aside first, so what is overwritten is no longer being read, and a run that fails may
    be repeated. Nothing is done without changes.
    """
    spark = changes.sparkSession
    new = materialize(_bucketed(changes, key, buckets), "changes")
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most ``buckets``
    if not touched:
        return []
    current = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    merged = materialize(upsert(current.select(*new.columns), new, key, version), "merged")
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def append_rejects(rejected: DataFrame, path: str | None = None) -> str:
    """Add rejected input rows (file, record, reason) to a reject table."""
    path = path or fresh_path(rejected.sparkSession, "rejects")
    rejected.write.mode("append").parquet(path)
    return path


def collection_stats(points: DataFrame, vector: str = "vec", document: str = "doc_id") -> DataFrame:
    """Documents, points and vector size of a collection."""
    return points.agg(
        F.countDistinct(document).alias("documents"),
        F.count("*").alias("points"),
        F.max(F.size(vector)).cast("bigint").alias("vector_size"),
    )


def save_graph(nodes: DataFrame, edges: DataFrame, path: str | None = None) -> str:
    path = path or fresh_path(nodes.sparkSession, "graph")
    nodes.write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("relationship").parquet(f"{path}/edges")
    return path


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
