"""Account health and risk by rules, for a whole account table at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from churnspark.functions.columns import clamp, pick, present

# Names of the eight product features, by feature number.
FEATURE_NAMES = (
    "Dashboard", "Analytics", "Reports", "Integrations", "API", "Mobile App", "Automation", "Collaboration",
)

# Inputs assumed for an account without activity data.
DEFAULT_SEGMENT_SHARE = 0.3
DEFAULT_TENURE = 2.0
DEFAULT_ENGAGEMENT = 0.5
DEFAULT_TICKETS = 2
DEFAULT_ADOPTION = 0.5
DEFAULT_LAST_ENGAGEMENT = 15
CONFIDENCE = 0.85


def activity(events: DataFrame, now: Column, days: int = 30, features: int = len(FEATURE_NAMES)) -> DataFrame:
    """Per account over the last ``days``: tickets, engagement, adoption, trend; and days since engagement.

    One partial aggregation. Features used are kept as bits, so no distinct shuffle is needed.
    """
    window_start = now - F.expr(f"INTERVAL {days} DAYS")
    middle = now - F.expr(f"INTERVAL {days * 12} HOURS")
    inside = F.col("ts") > window_start
    ticket = inside & (F.col("event_type") == "error")
    engaged = F.col("event_type").isin("click", "view")
    bit = F.when(inside, F.call_function("shiftleft", F.lit(1), F.col("feature")))
    per_account = events.groupBy("account_id").agg(
        F.count_if(inside).alias("_all"),
        F.count_if(inside & engaged).alias("_engaged"),
        F.count_if(ticket).alias("tickets"),
        F.count_if(ticket & (F.col("ts") > middle)).alias("_newer"),
        F.bit_or(bit).alias("_bits"),
        F.max(F.when(engaged, F.col("ts"))).alias("_last"),
    )
    older = F.col("tickets") - F.col("_newer")
    return per_account.select(
        "account_id",
        "tickets",
        F.when(F.col("_all") > 0, F.col("_engaged") / F.col("_all")).alias("engagement_score"),
        (F.coalesce(F.bit_count("_bits"), F.lit(0)) / F.lit(features)).alias("adoption_rate"),
        pick(
            (F.col("_newer") > older, "increasing"), (F.col("_newer") < older, "decreasing"), default="stable"
        ).alias("trend"),
        F.datediff(now, "_last").cast("bigint").alias("last_engagement_days"),
    )


def segment_shares(churned: DataFrame) -> DataFrame:
    """Share of churned accounts per segment."""
    counted = churned.filter("segment IS NOT NULL").groupBy("segment").agg(F.count("*").cast("double").alias("_n"))
    total = counted.agg(F.sum("_n")).scalar()
    return counted.select("segment", (F.col("_n") / total).alias("segment_share"))


def risk_level(score) -> Column:
    s = F.col(score)
    return pick((s >= 80, "Critical"), (s >= 60, "High"), (s >= 40, "Medium"), default="Low")


def _rules(share: Column, tenure: Column, engagement: Column, tickets: Column):
    """(points, factor text) per rule, in the order factors are listed."""
    # Rule thresholds, points and texts.
    return [
        ((share * 100 - 50) * 0.5, None),
        (
            pick((tenure < 1, 20), (tenure < 2, 10), default=0),
            pick((tenure < 1, "New customer (< 1 year)"), (tenure < 2, "Relatively new (< 2 years)")),
        ),
        (
            pick((engagement < 0.3, 25), (engagement < 0.5, 15), default=0),
            pick((engagement < 0.3, "Very low engagement"), (engagement < 0.5, "Below average engagement")),
        ),
        (
            pick((tickets > 5, 15), default=0),
            F.when(
                tickets > 5,
                F.concat(F.lit("High support volume ("), tickets.cast("string"), F.lit(" tickets/month)")),
            ),
        ),
    ]


def health(accounts: DataFrame) -> DataFrame:
    """Add score, level, factors and confidence to rows of health inputs.

    Needs ``segment_share``, ``tenure_years``, ``engagement_score`` and ``tickets``; NULL
    inputs take their defaults.
    """
    rules = _rules(
        F.coalesce("segment_share", F.lit(DEFAULT_SEGMENT_SHARE)),
        F.coalesce("tenure_years", F.lit(DEFAULT_TENURE)),
        F.coalesce("engagement_score", F.lit(DEFAULT_ENGAGEMENT)),
        F.coalesce("tickets", F.lit(DEFAULT_TICKETS)),
    )
    points = F.lit(50.0)
    for value, _ in rules:
        points = points + value
    return (
        accounts.withColumn("health_raw", clamp(points, 0.0, 100.0))
        .withColumn("health_score", F.round("health_raw", 1))
        .withColumn("risk_level", risk_level("health_raw"))
        .withColumn("risk_factors", present(*[text for _, text in rules if text is not None]))
        .withColumn("confidence", F.lit(CONFIDENCE))
    )


def portfolio(scored: DataFrame) -> DataFrame:
    """Add the blended risk score, expected days to churn and main risk reason."""
    share = F.coalesce("segment_share", F.lit(DEFAULT_SEGMENT_SHARE))
    newness = F.greatest(F.lit(0.0), (3.0 - F.col("tenure_years")) / 3.0)
    blended = share * 100 * 0.3 + F.col("health_raw") * 0.7 + newness * 5
    return (
        scored.withColumn("risk_raw", clamp(blended, 15.0, 95.0))
        .withColumn("risk_score", F.round("risk_raw", 1))
        .withColumn(
            "days_until_churn",
            pick((F.col("risk_raw") >= 80, 14), (F.col("risk_raw") >= 60, 29), default=60).cast("bigint"),
        )
        .withColumn(
            "risk_reason",
            pick(
                (F.col("tickets") > 5, "Support issues"),
                (F.col("engagement_score") < 0.5, "Low engagement"),
                (F.col("adoption_rate") < 0.4, "Feature gaps"),
                (F.col("tenure_years") < 1, "Poor onboarding"),
                default="Product fit concerns",
            ),
        )
    )


def score_accounts(accounts: DataFrame, churned: DataFrame, events: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Every account with its activity, health and portfolio risk."""
    inputs = (
        accounts.join(segment_shares(churned), "segment", "left")
        .join(activity(events, now, days), "account_id", "left")
        .withColumn("tickets", F.coalesce("tickets", F.lit(DEFAULT_TICKETS)).cast("bigint"))
        .withColumn("engagement_score", F.coalesce("engagement_score", F.lit(DEFAULT_ENGAGEMENT)))
        .withColumn("adoption_rate", F.coalesce("adoption_rate", F.lit(DEFAULT_ADOPTION)))
        .withColumn("trend", F.coalesce("trend", F.lit("stable")))
        .withColumn(
            "last_engagement_days", F.coalesce("last_engagement_days", F.lit(DEFAULT_LAST_ENGAGEMENT)).cast("bigint")
        )
    )
    return portfolio(health(inputs))


def at_risk(scored: DataFrame, threshold: float = 60.0, limit: int | None = 10) -> DataFrame:
    """Accounts at or above the threshold, highest risk first."""
    rows = scored.filter(F.col("risk_score") >= threshold).orderBy(F.desc("risk_score"), "account_id")
    return rows.limit(limit) if limit is not None else rows


def dashboard(scored: DataFrame, threshold: float = 60.0) -> DataFrame:
    """One row of portfolio totals; zeros if no account is at risk."""
    risky = F.col("risk_score") >= threshold
    return scored.agg(
        F.count_if(risky).alias("total_at_risk"),
        F.count_if(risky & (F.col("risk_score") >= 80)).alias("critical_risk_count"),
        F.coalesce(F.sum(F.when(risky, F.col("arr"))).cast("double"), F.lit(0.0)).alias("total_arr_at_risk"),
        F.coalesce(F.round(F.avg(F.when(risky, F.col("days_until_churn"))), 1), F.lit(0.0)).alias("avg_days_to_churn"),
        F.count("*").alias("total_active_customers"),
    )


def risk_bands(scored: DataFrame) -> DataFrame:
    """Accounts per risk band; bands without accounts are present with zero."""
    level = risk_level("risk_score")
    # Display names of the bands.
    names = {
        "Critical": "Critical (80-100%)",
        "High": "High (60-79%)",
        "Medium": "Medium (40-59%)",
        "Low": "Low (0-39%)",
    }
    one_row = scored.agg(*[F.count_if(level == k).alias(v) for k, v in names.items()])
    return one_row.unpivot([], [f"`{v}`" for v in names.values()], "band", "accounts")


def arr_by_segment(scored: DataFrame) -> DataFrame:
    return scored.groupBy("segment").agg(F.sum("arr").cast("double").alias("arr"), F.count("*").alias("accounts"))


def risk_reasons(scored: DataFrame, n: int = 6) -> DataFrame:
    """Most frequent risk reasons with their whole-number percentage of all accounts."""
    counted = scored.groupBy("risk_reason").agg(F.count("*").alias("accounts"))
    total = counted.agg(F.sum("accounts").cast("double")).scalar()
    percent = F.floor(F.col("accounts") / total * 100 + 0.5).cast("bigint")
    return counted.withColumn("percentage", percent).orderBy(F.desc("accounts"), "risk_reason").limit(n)


def engagement_weekly(events: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Weekly engagement points per account over the last ``days``, weeks without events included."""
    weeks = (days + 6) // 7
    age = F.datediff(now, "ts")
    counted = (
        events.filter(age < weeks * 7)
        .groupBy("account_id", F.floor(age / 7).cast("int").alias("weeks_ago"))
        .agg(F.count("*").alias("events"), F.count_if(F.col("event_type").isin("click", "view")).alias("engaged"))
    )
    grid = events.select("account_id").distinct().select(
        "account_id", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))).alias("weeks_ago")
    )
    return grid.join(counted, ["account_id", "weeks_ago"], "left").select(
        "account_id",
        F.date_sub(now.cast("date"), (F.col("weeks_ago") + 1) * 7).alias("week_start"),
        F.coalesce("events", F.lit(0)).alias("events"),
        F.when(
            F.col("events") > 0, F.round(clamp(F.col("engaged") / F.col("events"), 0.1, 1.0), 4)
        ).alias("engagement_score"),
    )


def feature_usage(events: DataFrame) -> DataFrame:
    """Per account and feature: share of the account's events and the last day of use.

    Counted per feature first; the account total is a window over at most eight rows.
    """
    per_feature = events.groupBy("account_id", "feature").agg(
        F.count("*").alias("uses"), F.max("ts").cast("date").alias("last_used")
    )
    all_uses = F.sum("uses").over(W.partitionBy("account_id"))
    names = F.array(*[F.lit(n) for n in FEATURE_NAMES])
    return per_feature.select(
        "account_id",
        F.element_at(names, F.col("feature") + 1).alias("feature"),
        F.round(F.col("uses") / all_uses, 4).alias("usage_rate"),
        "last_used",
    )


def ticket_history(events: DataFrame, scored: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Support tickets of the window with the priority of their account."""
    recent = events.filter((F.col("event_type") == "error") & (F.col("ts") > now - F.expr(f"INTERVAL {days} DAYS")))
    return recent.join(scored.select("account_id", "risk_score"), "account_id").select(
        "account_id",
        "event_id",
        F.col("ts").cast("date").alias("opened"),
        pick((F.col("risk_score") > 70, "High"), default="Medium").alias("priority"),
    )


def validate(inputs: DataFrame) -> DataFrame:
    """Add the list of violated bounds; an empty list means the row is valid."""
    # Bounds of the health inputs.
    bounds = (("tenure_years", 0, None), ("arr", 0, None), ("engagement_score", 0, 1), ("tickets", 0, None))
    reasons = []
    for name, low, high in bounds:
        reasons.append(F.when(F.col(name) < low, f"{name} < {low}"))
        if high is not None:
            reasons.append(F.when(F.col(name) > high, f"{name} > {high}"))
    return inputs.withColumn("violations", present(*reasons))
