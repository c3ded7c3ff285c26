"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass 1 scatters rows uniformly by seeded hashes: to a shard (the shard with the largest hash of id and shard wins, so
one more shard takes rows only into itself), and within the shard to one of several buckets that fit in memory.
Pass 2 shuffles each bucket by itself (Fisher-Yates, ``functions.shuffle``), writes its whole records in that order and
lays the buckets of a shard end to end. What the query reports is read from the written shards.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from churnspark.llm.common import free_name
from churnspark.operators.sizing import fits
from churnspark.session import fresh_path, materialize

#: Mean bytes of the records of one bucket.
BUCKET_BYTES = 64 * 1024 * 1024
#: Mean rows of one bucket; with the bytes above it bounds what pass 2 holds at a time.
BUCKET_ROWS = 50_000


def _draw(seed: int, *cols):
    return F.xxhash64(F.lit(seed), *cols)


def _shard(doc, shards: int, seed: int):
    draws = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(_draw(seed, doc, s).alias("h"), s.alias("s")))
    return F.array_max(draws)["s"]


def buckets_of(rows: int, size: int, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> int:
    """Buckets of a shard of so many rows and bytes."""
    return max(1, math.ceil(max(size / bucket_bytes, rows / bucket_rows)))


def external_shuffle(df: DataFrame, shards: int, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard.

    The whole records are written by ``write_shards``, and shard and slot are the places they have there. ``slot`` runs
    from 0 without gaps within each shard. A null text has size 16 and the checksum of no bytes. Repeated rows and null
    ids are rows like any other (equal ids share a shard). An empty table gives no rows.
    """
    path = write_shards(df, shards, None, seed, id_col, bucket_rows, text_col, bucket_bytes)
    name = _names(df)
    kinds = [f"`{id_col}` {dict(df.dtypes)[id_col]}", *(f"{name[c]} {t}" for c, t in _KINDS.items())]
    written = df.sparkSession.read.schema(", ".join(kinds)).parquet(path)
    placed = written.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), *[F.col(name[c]).alias(c) for c in _KINDS])
    # Starts of the buckets: as many rows as there are buckets.
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(_up_to_previous()), F.lit(0))
    starts = counts.select("shard", "bucket", before.alias("start"))
    return placed.join(starts, ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("pos")).cast("bigint").alias("slot"),
        "grown_shard",
    )


def _up_to_previous():
    from pyspark.sql import Window

    return Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)


#: Columns that are written beside those of a record.
_KINDS = {"size": "bigint", "text_crc32": "bigint", "grown_shard": "int", "pos": "int", "shard": "int", "bucket": "int"}


def _names(df: DataFrame) -> dict[str, str]:
    """Names of the columns beside the record's own that do not clash with them."""
    return {c: free_name(df, c) for c in _KINDS}


def write_shards(
    df: DataFrame,
    shards: int,
    path: str | None = None,
    seed: int = 1,
    id_col: str = "doc_id",
    bucket_rows: int = BUCKET_ROWS,
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> str:
    """Write whole records: ``path/shard=s/bucket=b`` holds the shuffled records of one bucket of one shard.

    Beside the record stand its size, checksum, ``grown_shard`` and ``pos``, its place in the bucket; names that the
    record has itself get underscores. One exchange of whole records to the buckets; a bucket is held by one task.
    """
    path = path or fresh_path(df.sparkSession, "shards")
    name, columns = _names(df), df.columns
    doc = F.col(f"`{id_col}`").cast("bigint")
    raw = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    sizes = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary") and c != text_col]
    held = F.octet_length(raw) + sum(sizes, F.lit(16))  # bytes of the whole record that can be long
    doc_name, sum_name, n_name = "doc", "crc", "copies"  # in a table of their own
    alike = df.select(doc.alias(doc_name), F.crc32(raw).alias(sum_name), held.cast("bigint").alias("bytes")).groupBy(doc_name, sum_name)
    alike = materialize(alike.agg(F.count("*").alias(n_name), F.sum("bytes").alias("bytes")), "copies")
    filled = alike.groupBy(_shard(F.col(doc_name), shards, seed).alias("shard")).agg(F.sum(n_name).alias("n"), F.sum("bytes").alias("bytes"))
    counts = {r["shard"]: buckets_of(r["n"], r["bytes"], bucket_bytes, bucket_rows) for r in filled.collect()}  # a row per shard
    total = sum(counts.values())
    sub = F.array(*[F.lit(counts.get(s, 1)) for s in range(shards)])[_shard(doc, shards, seed)]
    # Rows that repeat with id and text are told apart by their place in the input, so that no bucket gets them all.
    again = alike.where(F.col(n_name) > 1).select(doc_name, sum_name)
    copy, known = free_name(df, "_copy"), free_name(df, "_known")
    df = df.withColumn(copy, F.monotonically_increasing_id())
    if total > len(counts) and not again.isEmpty():
        marked = again.select(F.struct(doc_name, sum_name).alias(known))
        marked = F.broadcast(marked) if fits(marked) else marked
        df = df.join(marked, F.struct(doc.alias(doc_name), F.crc32(raw).alias(sum_name)).eqNullSafe(F.col(known)), "left")
        repeat = F.when(F.col(known).isNotNull(), F.col(copy)).otherwise(0)
    else:
        repeat = F.lit(0)
    maps = {c for c, t in df.dtypes if t.startswith("map")}
    own = [(F.map_entries(F.col(f"`{c}`")) if c in maps else F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(columns)]
    dealt = df.select(
        _shard(doc, shards, seed).alias("shard"),
        # Rows of one id are spread over the buckets of their shard by their checksum as well, equal rows by their place.
        F.pmod(_draw(seed + 1, doc, F.crc32(raw), repeat), sub).cast("int").alias("bucket"),
        F.struct(
            doc.alias("doc"), (F.octet_length(raw) + 16).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), _shard(doc, shards + 1, seed).alias("grown_shard"), *own
        ).alias("record"),
    )
    # Rows go to their buckets one by one: no task gathers records before the exchange, and a task has about one bucket.
    filled = dealt.repartition(max(1, total), "shard", "bucket").groupBy("shard", "bucket").agg(F.sort_array(F.collect_list("record")).alias("rows"))
    # Buckets are in a fixed order within each task, so a task that is run again draws the same shuffles.
    mixed = filled.sortWithinPartitions("shard", "bucket").select("shard", "bucket", F.shuffle("rows", seed).alias("rows"))
    laid = mixed.select("shard", "bucket", F.posexplode("rows").alias("pos", "r"))
    back = [(F.map_from_entries(f"r._{i}") if c in maps else F.col(f"r._{i}")).alias(c) for i, c in enumerate(columns)]
    beside = [F.col(f"r.{c}" if c in ("size", "text_crc32", "grown_shard") else c).alias(name[c]) for c in _KINDS]
    keys = [name["shard"], name["bucket"]]
    laid.select(*back, *beside).sortWithinPartitions(*keys, name["pos"]).write.partitionBy(*keys).parquet(path)
    return path
