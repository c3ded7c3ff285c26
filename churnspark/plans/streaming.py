"""Streaming queries, checked against the same aggregation over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnspark.plans.registry import query
from churnspark.streaming import events as S


def stream(wh):
    return S.read_events(wh.spark, f"{wh.root}/events.parquet")


INGEST_SQL = "SELECT event_id, user_id AS account_id, ts, event_type FROM events"
TICKETS_SQL = """
SELECT window_start, window_start + INTERVAL 30 DAYS AS window_end, user_id AS account_id, count(*) AS tickets
FROM (SELECT user_id, unnest(list_transform(range(30), lambda i: date_trunc('day', ts) - i * INTERVAL 1 DAY)) AS window_start
      FROM events WHERE event_type = 'error') GROUP BY ALL
"""
WEEKLY_SQL = """
SELECT TIMESTAMP '1970-01-01' + (floor(epoch(ts) / 604800) * 7)::INT * INTERVAL 1 DAY AS week_start, user_id AS account_id,
       count(*) AS events, count(*) FILTER (event_type IN ('click', 'view')) AS engaged
FROM events GROUP BY 1, 2
"""


@query("STR1", INGEST_SQL)
def stream_ingest(wh):
    """Every event arrives twice and is kept once."""
    twice = stream(wh).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return S.run_available(S.deduplicated(twice, S.backlog_delay(wh.events)), ["event_id"], "append")


@query("STR2", TICKETS_SQL)
def stream_tickets(wh):
    return S.run_available(S.tickets_sliding(stream(wh), delay=S.backlog_delay(wh.events)), ["window_start", "window_end", "account_id"])


@query("STR3", WEEKLY_SQL)
def stream_weekly(wh):
    return S.run_available(S.engagement_weekly(stream(wh), S.backlog_delay(wh.events)), ["week_start", "account_id"])


# Backlog and live stream as two phases: the last LIVE_DAYS of the table arrive as a stream, in slices by time.

LIVE_DAYS, SLICES = 30, 5


def two_phases(wh, sent_late=None):
    """(handover, live stream): ``sent_late`` selects backlog events that the stream sends again."""
    events = wh.table("events")
    cut = F.lit(events.agg(F.date_trunc("day", F.max("ts")) - F.expr(f"INTERVAL {LIVE_DAYS} DAYS")).first()[0]).cast("timestamp_ntz")
    older = events.where(F.col("ts") < cut)
    backlog = older.select("event_id", F.col("user_id").alias("account_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    handed = S.hand_over(backlog)
    path = S.written_in_slices(events.where(F.col("ts") >= cut).select(*S.EVENT_COLUMNS), SLICES)
    if sent_late is not None:
        sent_late(older, F.lit(handed.watermark).cast("timestamp_ntz")).select(*S.EVENT_COLUMNS).coalesce(1).write.parquet(f"{path}/slice={SLICES}")
    return handed, S.read_events(wh.spark, f"{path}/*/*.parquet", max_files=1)


@query("STR1", INGEST_SQL)
def stream_ingest_after_backlog(wh):
    """Every live event arrives twice, and the backlog's last day again; each event is kept once."""
    handed, live = two_phases(wh, lambda older, watermark: older.where(F.col("ts") >= watermark))
    twice = live.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return S.continued_ingest(handed, twice)


@query("STR2", TICKETS_SQL)
def stream_tickets_after_backlog(wh):
    handed, live = two_phases(wh)
    return S.continued(handed, live, S.tickets_sliding, ["window_start", "window_end", "account_id"])


def late_again(older, watermark):
    """Every tenth event from behind the watermark."""
    return older.where((F.col("ts") < watermark) & (F.col("event_id") % 10 == 0))


@query("STR3", WEEKLY_SQL)
def stream_weekly_after_backlog(wh):
    """Old events that the stream sends again come after the watermark and change nothing."""
    handed, live = two_phases(wh, late_again)
    return S.continued(handed, live, S.engagement_weekly, ["week_start", "account_id"])


@query(
    "STR3",
    f"""
WITH cut AS (SELECT date_trunc('day', max(ts)) - INTERVAL {LIVE_DAYS} DAYS AS t FROM events),
handed AS (SELECT max(ts) AS last FROM events, cut WHERE ts < t)
SELECT count(*) FILTER (ts < date_trunc('second', last) - INTERVAL 1 DAY AND event_id % 10 = 0) AS late, count(*) FILTER (ts >= t) AS live FROM events, cut, handed
""",
)
def stream_late_events(wh):
    """How many events the stream dropped as late, and how many it took."""
    handed, live = two_phases(wh, late_again)
    progress = []
    S.continued(handed, live, S.engagement_weekly, ["week_start", "account_id"], progress)
    late = sum(p["late"] + p["dropped"] for p in progress)
    taken = live_events(wh)
    return taken.select(F.lit(late).cast("bigint").alias("late"), "live")


def live_events(wh):
    events = wh.table("events")
    cut = events.agg(F.date_trunc("day", F.max("ts")) - F.expr(f"INTERVAL {LIVE_DAYS} DAYS")).first()[0]
    return events.agg(F.count_if(F.col("ts") >= F.lit(cut).cast("timestamp_ntz")).alias("live"))
