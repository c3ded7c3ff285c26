"""Account events as streams: deduplicated ingest, sliding ticket counts, weekly engagement.

Each transform takes a DataFrame of (event_id, account_id, ts, event_type) and works the same
on a stream and on a table, which is how the two are checked against each other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from churnspark.session import fresh_path

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
EVENT_COLUMNS = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]


def read_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The files of one table (a file or a folder of files) as a stream, ``max_files`` at a time if given.

    Event time is a timestamp so that it can carry a watermark.
    """
    # As a pattern the path may be a file or a folder; as a plain path it would have to be a folder.
    if not any(c in path for c in "*?[{"):
        path = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).select(
        "event_id", F.col("user_id").alias("account_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type"
    )


def written_in_slices(table: DataFrame, slices: int, ts: str = "ts") -> str:
    """A folder in which a table arrives as ``slices`` files or more, oldest events first, as a live stream would be."""
    path = fresh_path(table.sparkSession, "live")
    ends = table.agg(F.min(ts).alias("first"), F.max(ts).alias("last")).first()
    if ends["first"] is None:
        table.write.parquet(f"{path}/slice=0")
        return path
    step = (ends["last"] - ends["first"]) / slices
    for i in range(slices):
        after = F.lit(True) if i == 0 else F.col(ts) >= F.lit(ends["first"] + i * step)
        before = F.lit(True) if i == slices - 1 else F.col(ts) < F.lit(ends["first"] + (i + 1) * step)
        table.where(after & before).coalesce(1).write.parquet(f"{path}/slice={i}")
    return path


def backlog_delay(table: DataFrame, ts: str = "ts", delay_seconds: int = 86_400) -> str:
    """Watermark delay under which nothing of a backlog is late, in whatever order its files are read.

    It is the span of event times in the table plus the usual delay; with it the watermark stays behind the oldest
    event until the whole backlog is read.
    """
    ends = table.agg(F.min(ts).cast("timestamp").cast("long").alias("first"), F.max(ts).cast("timestamp").cast("long").alias("last")).first()
    span = (ends["last"] or 0) - (ends["first"] or 0)
    return f"{span + delay_seconds} seconds"


def deduplicated(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each event once, as long as its copies come within the watermark; state is bounded by it."""
    marked = events.withWatermark("ts", delay)
    return marked.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def tickets_sliding(events: DataFrame, window: str = "30 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Support tickets per account in sliding windows."""
    return (
        events.filter("event_type = 'error'")
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", window, slide).alias("w"), "account_id")
        .agg(F.count("*").alias("tickets"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "account_id", "tickets")
    )


def engagement_weekly(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events and engaged events per account and week; events later than the watermark are dropped."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", "7 days").alias("w"), "account_id")
        .agg(F.count("*").alias("events"), F.count_if(F.col("event_type").isin("click", "view")).alias("engaged"))
        .select(F.col("w.start").alias("week_start"), "account_id", "events", "engaged")
    )


def run_available(result: DataFrame, keys: list[str], mode: str = "update", progress: list | None = None) -> DataFrame:
    """Process what is there, into a table of its own, and return the newest row per key.

    The sink writes each batch under its number, so a batch that is run again after a failure
    replaces its own rows. In ``update`` mode a key may have rows in several batches. ``progress`` receives for each
    batch the rows that state held, the rows the watermark dropped, and the rows that ``on_time`` found late.
    """
    spark = result.sparkSession
    if progress is not None:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "10000")
    path, checkpoint = fresh_path(spark, "stream"), fresh_path(spark, "stream-checkpoint")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        result.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    if progress is not None:
        progress += [_figures(p) for p in query.recentProgress]
    others = [c for c in result.columns if c not in keys]
    written = T.StructType([*result.schema.fields, T.StructField("batch", T.IntegerType())])
    rows = spark.read.option("basePath", path).schema(written).parquet(path)
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_row"))
    return newest.select(*keys, "_row.*").select(*result.columns)


def _figures(progress) -> dict[str, int]:
    states = progress.stateOperators
    late = progress.observedMetrics.get("late")
    return {
        "batch": progress.batchId,
        "state": sum(s.numRowsTotal for s in states),
        "dropped": sum(s.numRowsDroppedByWatermark for s in states),
        "late": late["late"] if late else 0,
    }


# A backlog and the live stream after it, as two phases.


@dataclass(frozen=True)
class Handover:
    """What a backlog hands to the live stream: its events and the watermark they have set."""

    backlog: DataFrame
    watermark: datetime
    delay: str


def hand_over(backlog: DataFrame, delay_seconds: int = 86_400) -> Handover:
    """The state of event time after a backlog (event_id, account_id, ts, event_type), which is read as a table, so its
    events are never late whatever their order. An empty backlog makes nothing late."""
    last = backlog.agg(F.max("ts").cast("timestamp").cast("long")).first()[0]
    return Handover(backlog, datetime.fromtimestamp((last or 0) - delay_seconds, timezone.utc), f"{delay_seconds} seconds")


def on_time(live: DataFrame, handed: Handover) -> DataFrame:
    """Live events that are not behind the backlog's watermark. Later on the stream's own watermark, with the same delay,
    decides; late events are counted in the progress of the query."""
    late = F.col("ts") < F.lit(handed.watermark)
    return live.observe("late", F.count_if(late).alias("late")).where(~late)


def continued(handed: Handover, live: DataFrame, aggregate: Callable[..., DataFrame], keys: list[str], progress: list | None = None) -> DataFrame:
    """Counts over a backlog and the live stream after it: the backlog is aggregated as a table, the stream with its real
    watermark, and counts of a window that both have part in are added. State holds only windows that are still open."""
    done = aggregate(handed.backlog)
    rows = run_available(aggregate(on_time(live, handed), delay=handed.delay), keys, progress=progress)
    sums = [F.sum(c).alias(c) for c in done.columns if c not in keys]
    return done.unionByName(rows).groupBy(*keys).agg(*sums).select(*done.columns)


def continued_ingest(handed: Handover, live: DataFrame, progress: list | None = None) -> DataFrame:
    """Each event of a backlog and the live stream after it once. Copies of backlog events can only come on time within
    the delay, so only the ids of that span are looked up."""
    recent = handed.backlog.where(F.col("ts") >= F.lit(handed.watermark)).select("event_id").distinct()
    new = on_time(live, handed).join(recent, "event_id", "left_anti")
    rows = run_available(deduplicated(new, handed.delay), ["event_id"], "append", progress)
    return deduplicated(handed.backlog).unionByName(rows)
