"""Readers of the account export, the corpora, text folders and metadata."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from churnspark.functions.columns import null_if_missing, parse_date, parse_money
from churnspark.session import local_path, materialize
from churnspark.sources.sinks import CSV_OPTIONS, TASK_FILES

# Columns of the account export and the names used here.
EXPORT_NAMES = {
    "Account Segment": "segment",
    "Account Name": "account_name",
    "Opportunity Name": "opportunity_name",
    "Close Date": "close_date",
    "Deal Type": "deal_type",
    "Amount": "arr",
    "Products (Rollup)": "products_rollup",
    "Competitor 1": "competitor_1",
    "Competitor 2": "competitor_2",
    "Primary Outcome Reason": "primary_reason",
    "Outcome Sub Reason": "sub_reason",
    "Lost Opportunity Details": "details",
    "First Win Date": "first_win_date",
    "Tenure (years)": "tenure_years",
}

# Schemas of the corpus files.
INTERACTIONS = (
    "company_name string, segment string, interaction_date date, interaction_type string, content string, "
    "customer_tenure_months int"
)
TICKETS = (
    "ticket_id string, company_name string, segment string, category string, issue_type string, severity string, "
    "created_date timestamp, resolved_date timestamp, resolution_hours int, description string, "
    "resolution_notes string, csat_score int"
)
STORIES = (
    "story_id string, company_name string, segment string, title string, challenge_category string, "
    "specific_challenge string, solution string, arr int, team_size int, adoption_before int, adoption_after int, "
    "engagement_increase int, support_reduction int, full_story string"
)
ANALYSES = (
    "doc_id string, company_name string, segment string, churn_category string, specific_reason string, arr int, "
    "tenure_months int, risk_score int, feature_adoption int, support_tickets_30d int, last_engagement_days int, "
    "document string"
)
METADATA = (
    "generated_date string, data_files map<string,string>, document_collections map<string,string>, "
    "statistics struct<total_companies:bigint,segments:array<string>,churn_categories:array<string>>, "
    "usage struct<description:string,recommended_chunk_size:int,recommended_overlap:int>"
)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and quoted fields that may span lines."""
    return (
        spark.read.schema(schema)
        .options(**CSV_OPTIONS, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(path)
    )


def read_csv_checked(spark: SparkSession, path: str, schema: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows) of a CSV: a row with another number of fields, or with a value that is not of its
    column's type, is rejected with its file, its text and the reason, and changes no other row.

    Both sides read one written table, so the files are parsed once.
    """
    fields = T._parse_datatype_string(schema).fields
    kinds = T.StructType([*fields, T.StructField("_corrupt", T.StringType())])
    options = {**CSV_OPTIONS, "header": header, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    raw = spark.read.schema(kinds).options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").csv(path)
    read = materialize(raw.select("*", F.col("_metadata.file_path").alias("_file")), "checked")
    good = read.where("_corrupt IS NULL").select(*[f.name for f in fields])
    # One column more than the schema has shows whether there are too many fields.
    names = [f"c{i}" for i in range(len(fields) + 1)]
    plain = ", ".join(f"{n} string" for n in names)
    cells = F.from_csv("_corrupt", plain, {**{k: str(v) for k, v in CSV_OPTIONS.items()}, "mode": "PERMISSIVE"})
    wrong = [
        F.when(F.col(f"v.c{i}").isNotNull() & F.col(f"v.c{i}").try_cast(f.dataType).isNull(), F.lit(f"{f.name} is not {f.dataType.simpleString()}"))
        for i, f in enumerate(fields)
    ]
    count = F.when(F.col(f"v.{names[-1]}").isNotNull(), F.lit("too many fields")).when(F.col(f"v.{names[-2]}").isNull(), F.lit("too few fields"))
    reason = F.coalesce(count, *wrong, F.lit("malformed"))
    bad = read.where("_corrupt IS NOT NULL").select(F.col("_file").alias("file"), F.col("_corrupt").alias("record"), cells.alias("v"))
    return good, bad.select("file", "record", reason.alias("reason"))


def read_account_export(spark: SparkSession, path: str) -> DataFrame:
    """The churned-account export, cleaned: typed money and dates, NULL for "no value"."""
    schema = ", ".join(f"`{name}` string" for name in EXPORT_NAMES)
    raw = read_csv(spark, path, schema)
    typed = {
        "close_date": parse_date,
        "first_win_date": parse_date,
        "arr": parse_money,
        "tenure_years": lambda c: c.try_cast("double"),
        "details": lambda c: F.when(~F.trim(c).isin("", "N/A"), c),
    }
    return raw.select(*[typed.get(new, null_if_missing)(F.col(f"`{old}`")).alias(new) for old, new in EXPORT_NAMES.items()])


def read_text_folder(spark: SparkSession, path: str, source_type: str, collection: str) -> DataFrame:
    """One document per text file of a folder and the folders in it, with its file name, source type and collection.

    As with Spark's reader, which reads all but plain files of a local file system, hidden and empty files are left out.
    """
    files = _local_files(spark, path)
    if files is None:
        read = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_name").alias("file_name"),
            F.col("value").alias("content"),
        )
    else:
        read = files.mapInArrow(_read_files, "file_path string, file_name string, content binary")
    return read.select(
        "file_path",
        "file_name",
        F.col("content").cast("string").alias("content"),
        F.lit(source_type).alias("source_type"),
        F.lit(collection).alias("collection"),
    )


#: Bytes that one task of ``read_text_folder`` reads on average, if its files are not more than ``sinks.TASK_FILES``.
TASK_BYTES = 128 << 20
#: Rows and bytes of a batch that leaves such a task.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20

# Endings of the files that Hadoop's codecs unpack.
PACKED = (b".gz", b".bz2", b".deflate", b".lz4", b".snappy", b".zst", b".passthrough")
#: A path as it is, and characters that a URI holds unescaped.
PLAIN_PATH = re.compile(r"[A-Za-z0-9/_.!~'()*,;:$&+=@-]*")
UNESCAPED = "/_.!~'()*,;:$&+=@-"


def _local_files(spark: SparkSession, path: str) -> DataFrame | None:
    """Files (path binary) of a folder in a local file system, dealt to tasks by number and bytes; None if they
    are for Spark to read: another store, a pattern or single file, packed files, files with a checksum beside them.

    Spark's own reader lists in at most 10,000 tasks, however short, has the driver keep 1.3 KB per file, and looks for all
    codecs again for each. Here one task lists the folder, many the folders in it, and the list is a table.
    """
    root = None if re.search(r"[*?\[\]{}\\]", path) else local_path(spark, path)
    if root is None or not os.path.isdir(root):
        return None
    kind = "path binary, is_folder boolean, bytes bigint, for_spark boolean"
    top = spark.range(1, numPartitions=1).mapInArrow(_lister(os.fsencode(root)), kind)
    dealt = top.repartition(4 * spark.sparkContext.defaultParallelism, "path")
    files = materialize(dealt.mapInArrow(_lister(), kind), "files")
    found = files.agg(F.count("*"), F.sum("bytes"), F.max("for_spark")).first()
    if found[2]:
        return None
    tasks = max(1, -(-found[0] // TASK_FILES), -(-(found[1] or 0) // TASK_BYTES))
    return files.select("path").repartition(tasks, "path")


def _lister(root: bytes | None = None):
    """List the entries of one folder, or with none given, each file and all files in each folder among the rows."""

    def entries(folder: bytes, deep: bool) -> Iterator[tuple]:
        with os.scandir(folder) as found:
            for entry in found:
                name = entry.name
                if name.startswith(b".") and name.endswith(b".crc"):
                    yield entry.path, False, 0, True
                if name.startswith(b".") or name.endswith(b"._COPYING_") or (name.startswith(b"_") and b"=" not in name):
                    continue
                if entry.is_dir():
                    yield from entries(entry.path, True) if deep else [(entry.path, True, 0, False)]
                elif entry.is_file() and (size := entry.stat().st_size):
                    yield entry.path, False, size, name.endswith(PACKED)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            if root is not None:
                yield from entries(root, False)
                continue
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                yield from entries(row[0], True) if row[1] else [row]

    types = pa.schema([("path", pa.binary()), ("is_folder", pa.bool_()), ("bytes", pa.int64()), ("for_spark", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = rows(batches)
        while part := list(islice(found, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*part), types)], schema=types)

    return run


def _uri(path: str) -> str:
    """The path as Spark's file metadata has it."""
    if PLAIN_PATH.fullmatch(path):
        return f"file:{path}"
    escaped = lambda c: c < "\x80" or unicodedata.category(c) in ("Cc", "Zs", "Zl", "Zp")
    return "file:" + "".join(quote(c, safe=UNESCAPED) if escaped(c) else c for c in path)


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = pa.schema([("file_path", pa.string()), ("file_name", pa.string()), ("content", pa.binary())])

    def full():
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), types)], schema=types)

    rows, size = [], 0
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with open(path, "rb") as file:
                content = file.read()
            name = path.decode("utf-8", "replace")
            rows.append((_uri(name), name.rpartition("/")[2], content))
            size += len(content)
            if len(rows) == BATCH_ROWS or size > BATCH_BYTES:
                yield full()
                rows, size = [], 0
    if rows:
        yield full()


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The JSON file that describes the data files."""
    return spark.read.schema(METADATA).json(path, multiLine=True)


def optional(spark: SparkSession, read, schema: str) -> DataFrame:
    """What ``read()`` returns, or an empty table of that schema if its path does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
