"""Ticket, story, interaction and analysis rows read off the warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from churnspark.operators.scoring import FEATURE_NAMES
from churnspark.sources.tables import Warehouse, churn_table


def tickets(wh: Warehouse) -> DataFrame:
    """An error event is a support ticket of its account, closed after ``value`` hours."""
    names = F.array(*[F.lit(n) for n in FEATURE_NAMES])
    category = F.element_at(names, F.col("feature") + 1)
    hours = F.ceil("value").cast("int")
    errors = wh.events.filter("event_type = 'error'")
    return errors.join(wh.accounts.select("account_id", "account_name", "segment"), "account_id").select(
        F.concat(F.lit("TICKET-"), F.col("event_id")).alias("ticket_id"),
        F.col("account_name").alias("company_name"),
        "segment",
        category.alias("category"),
        F.col("event_type").alias("issue_type"),
        F.when(hours > 24, "High").when(hours > 8, "Medium").otherwise("Low").alias("severity"),
        F.col("ts").alias("created_date"),
        F.expr("timestampadd(HOUR, CAST(ceil(value) AS INT), ts)").alias("resolved_date"),
        hours.alias("resolution_hours"),
        F.concat(F.lit("Problem with "), category).alias("description"),
        F.concat(F.lit("Fixed in "), category).alias("resolution_notes"),
        (F.pmod("event_id", F.lit(5)) + 1).cast("int").alias("csat_score"),
    )


def stories(wh: Warehouse) -> DataFrame:
    """Active accounts with events: features used in the first and in the second half of their events' span."""
    span = wh.events.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    middle = span.select(F.timestamp_seconds((F.unix_timestamp("a") + F.unix_timestamp("b")) / 2)).scalar()

    def adoption(condition):
        bits = F.bit_or(F.when(condition, F.call_function("shiftleft", F.lit(1), F.col("feature"))))
        return (F.coalesce(F.bit_count(bits), F.lit(0)) * 100 / len(FEATURE_NAMES)).cast("int")

    usage = wh.events.groupBy("account_id").agg(
        adoption(F.col("ts") < middle).alias("adoption_before"), adoption(F.col("ts") >= middle).alias("adoption_after")
    )
    return wh.active.join(usage, "account_id").select(
        F.concat(F.lit("STORY-"), F.col("account_id")).alias("story_id"),
        F.col("account_name").alias("company_name"),
        "segment",
        F.concat(F.lit("Adoption at "), F.col("account_name")).alias("title"),
        F.col("primary_reason").alias("challenge_category"),
        F.col("sub_reason").alias("specific_challenge"),
        F.lit("Product training").alias("solution"),
        F.col("arr").cast("int").alias("arr"),
        F.lit(None).cast("int").alias("team_size"),
        "adoption_before",
        "adoption_after",
        (F.col("adoption_after") - F.col("adoption_before")).alias("engagement_increase"),
        F.lit(None).cast("int").alias("support_reduction"),
        F.format_string(
            "%s went from %d%% to %d%% feature adoption.", "account_name", "adoption_before", "adoption_after"
        ).alias("full_story"),
    )


def interactions(wh: Warehouse) -> DataFrame:
    """Conversation turns as interactions of the account with the conversation's number."""
    months = F.floor(F.col("tenure_years") * 12).cast("int")
    turns = wh.table("conversations")
    return turns.join(wh.accounts, F.col("conv_id") == F.col("account_id")).select(
        F.col("account_name").alias("company_name"),
        "segment",
        months.alias("tenure_months"),
        F.col("turn").alias("at"),
        F.col("role").alias("kind"),
        F.col("text").alias("content"),
    )


def account_export(wh: Warehouse) -> DataFrame:
    """The churned accounts in the export's own columns and text formats."""
    table = churn_table(wh)
    text = lambda c: F.date_format(c, "M/d/yyyy")
    return table.select(
        F.col("segment").alias("Account Segment"),
        F.col("account_name").alias("Account Name"),
        F.concat(F.lit("Renewal - "), F.col("segment")).alias("Opportunity Name"),
        text("close_date").alias("Close Date"),
        F.lit("Renewal").alias("Deal Type"),
        F.concat(F.lit("$"), F.format_number(F.col("arr"), 2)).alias("Amount"),
        F.col("products_rollup").alias("Products (Rollup)"),
        F.col("competitor_1").alias("Competitor 1"),
        F.coalesce("competitor_2", F.lit("None mentioned")).alias("Competitor 2"),
        F.col("primary_reason").alias("Primary Outcome Reason"),
        F.col("sub_reason").alias("Outcome Sub Reason"),
        F.col("details").alias("Lost Opportunity Details"),
        text("first_win_date").alias("First Win Date"),
        F.col("tenure_years").cast("string").alias("Tenure (years)"),
    )
