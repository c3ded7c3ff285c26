"""Documents from accounts, tickets, stories and interactions, and their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from churnspark.functions.columns import money2
from churnspark.operators.ranking import top_per_group

# Texts that stand for missing fields in a document.
MISSING_TEXTS = {
    "sub_reason": "N/A",
    "competitor_1": "None mentioned",
    "competitor_2": "None mentioned",
    "products_rollup": "N/A",
    "details": "No details provided",
}

# Display label per source type.
SOURCE_LABELS = {
    "churn_analysis": "📊 Similar Churn Case",
    "success_story": "✅ Success Story",
    "support_ticket": "🎫 Support Ticket",
    "interaction_history": "💬 Customer Interaction",
}
DEFAULT_LABEL = "📄 Reference"


def fill_missing(accounts: DataFrame) -> DataFrame:
    return accounts.fillna({c: t for c, t in MISSING_TEXTS.items() if c in accounts.columns})


def account_text() -> Column:
    """Profile text of one churned account."""
    # Headings and line formats of the profile.
    line = lambda label, c: F.concat(F.lit(label), F.col(c).cast("string"))
    return F.concat_ws(
        "\n",
        F.lit("Customer Churn Profile\n======================"),
        line("Company: ", "account_name"),
        line("Segment: ", "segment"),
        line("Churn Date: ", "close_date"),
        F.concat(F.lit("Lost ARR: "), money2("arr")),
        F.concat(F.lit("Customer Tenure: "), F.col("tenure_years").cast("string"), F.lit(" years")),
        line("First Win Date: ", "first_win_date"),
        F.lit("\nChurn Analysis\n--------------"),
        line("Primary Reason: ", "primary_reason"),
        line("Sub Reason: ", "sub_reason"),
        F.lit("\nCompetitive Intelligence\n------------------------"),
        line("Competitor 1: ", "competitor_1"),
        line("Competitor 2: ", "competitor_2"),
        F.lit("\nProducts Used\n-------------"),
        F.col("products_rollup"),
        F.lit("\nDetailed Churn Story\n-------------------"),
        F.col("details"),
    )


def account_documents(accounts: DataFrame, source: str = "churned_accounts") -> DataFrame:
    """One document per account: text, metadata for filters, and the account's own key as record id."""
    filled = fill_missing(accounts)
    metadata = F.struct(
        "account_name",
        "segment",
        F.col("primary_reason").alias("churn_reason"),
        F.col("sub_reason").alias("churn_sub_reason"),
        F.col("close_date").cast("string").alias("churn_date"),
        "tenure_years",
        F.col("arr").cast("double").alias("arr_lost"),
        "competitor_1",
        "competitor_2",
        F.col("first_win_date").cast("string").alias("first_win_date"),
        F.lit(source).alias("source"),
        F.col("account_id").alias("record_id"),
    )
    return filled.select(
        F.col("account_id").alias("doc_id"), account_text().alias("content"), metadata.alias("metadata")
    )


def _document(df: DataFrame, source_type: str, key: str, content: Column, fields: list[Column]) -> DataFrame:
    return df.select(
        F.concat(F.lit(f"{source_type}-"), F.col(key).cast("string")).alias("doc_id"),
        F.lit(source_type).alias("source_type"),
        "company_name",
        "segment",
        content.alias("content"),
        F.to_json(F.struct(*fields)).alias("metadata"),
    )


def ticket_documents(tickets: DataFrame) -> DataFrame:
    # Line formats of a ticket document.
    content = F.format_string(
        "Support Ticket: %s\nCompany: %s (%s)\nCategory: %s - %s\nSeverity: %s\n\nDescription:\n%s\n\n"
        "Resolution:\n%s\n\nResolution Time: %d hours\nCSAT Score: %d/5",
        *[F.col(c) for c in (
            "ticket_id", "company_name", "segment", "category", "issue_type", "severity", "description",
            "resolution_notes", "resolution_hours", "csat_score",
        )],
    )
    fields = [F.col(c) for c in ("ticket_id", "category", "severity", "resolution_hours", "csat_score")]
    return _document(tickets, "support_ticket", "ticket_id", content, fields)


def story_documents(stories: DataFrame) -> DataFrame:
    improvement = (F.col("adoption_after") - F.col("adoption_before")).cast("double").alias("adoption_improvement")
    fields = [F.col("story_id"), F.col("challenge_category"), F.col("solution"), F.col("arr"), improvement]
    return _document(stories, "success_story", "story_id", F.col("full_story"), fields)


def interaction_documents(interactions: DataFrame, n: int = 10) -> DataFrame:
    """One document per company: its ``n`` newest interactions and how many there are.

    ``interactions``: company_name, segment, tenure_months, at (sortable), kind, content. Only ``n``
    rows per company leave a task, so a company with most of the rows is no hot spot.
    """
    # A company's segment and tenure are those of its first row.
    first = F.struct("at", "kind", "content")
    totals = interactions.groupBy("company_name").agg(
        F.count("*").alias("total_interactions"),
        F.min_by("segment", first).alias("segment"),
        F.min_by("tenure_months", first).alias("tenure_months"),
    )
    newest = top_per_group(interactions, "company_name", [F.desc("at"), "kind", "content"], n, "_rank")
    line = F.concat(F.lit("["), F.col("at").cast("string"), F.lit("] "), F.col("kind"), F.lit(": "), F.col("content"))
    lines = F.array_sort(F.collect_list(F.struct("_rank", line.alias("line"))))
    listed = newest.groupBy("company_name").agg(F.transform(lines, lambda x: x["line"]).alias("lines"))
    # Line formats of an interaction document.
    content = F.concat(
        F.format_string(
            "Customer Interaction History: %s\nSegment: %s\nTenure: %d months\n\nRecent Interactions (%d total):\n",
            "company_name", "segment", "tenure_months", "total_interactions",
        ),
        F.array_join("lines", "\n"),
    )
    fields = [F.col("total_interactions"), F.col("tenure_months")]
    return _document(totals.join(listed, "company_name"), "interaction_history", "company_name", content, fields)


def union_documents(*corpora: DataFrame) -> DataFrame:
    """All corpora as one document table."""
    out = corpora[0]
    for other in corpora[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def source_label(c) -> Column:
    label = F.lit(DEFAULT_LABEL)
    for source, text in SOURCE_LABELS.items():
        label = F.when(F.col(c) == source, text).otherwise(label)
    return label
