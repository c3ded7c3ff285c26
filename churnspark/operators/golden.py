"""Golden questions from the churn facts, with reference contexts and expected sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from churnspark.functions.columns import money0, one_decimal, truncate
from churnspark.operators.profile import mean, ranked_text
from churnspark.operators.questions import mentions
from churnspark.operators.ranking import top_per_group
from churnspark.session import materialize

# Sources expected when no account is named, by question category.
DEFAULT_SOURCES = {
    "pattern_analysis": "multiple_customers,aggregate_data",
    "competitive_intelligence": "competitor_data,switching_patterns",
    "financial_analysis": "financial_data,arr_analysis",
    "segment_analysis": "segment_data,comparative_analysis",
}
MAX_SOURCES = 5

#: (category, subject, question with the subject in place of %s)
TEMPLATES = (
    ("customer_specific", "account_name", "Why did %s churn and what did they switch to?"),
    ("pattern_analysis", "primary_reason", "What patterns are common among customers lost to %s?"),
    ("segment_analysis", "segment", "Which risks are unique to the %s segment?"),
    ("financial_analysis", "segment", "How much recurring revenue did we lose with %s customers?"),
    ("competitive_intelligence", "competitor", "Which customers switch to %s as an alternative?"),
)


def questions(accounts: DataFrame, rivals: DataFrame, categories: tuple[str, ...] | None = None) -> DataFrame:
    """(question_id, query_type, question, difficulty): every template over every value of its subject."""
    parts = []
    for category, subject, template in TEMPLATES:
        if categories and category not in categories:
            continue
        values = (rivals if subject == "competitor" else accounts).select(F.col(subject).alias("subject"))
        parts.append(
            values.filter("subject IS NOT NULL")
            .distinct()
            .select(
                F.concat(F.lit(f"{category}:"), "subject").alias("question_id"),
                F.lit(category).alias("query_type"),
                F.format_string(template, "subject").alias("question"),
                F.lit("medium").alias("difficulty"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def first_mention(asked: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """(question_id, name): of the names in the question the first in name order."""
    found = mentions(asked, names, "question_id", "question", name)
    return found.groupBy("question_id").agg(F.min(name).alias(name))


def _line(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def account_facts(table: DataFrame) -> DataFrame:
    """(account_name, fact): one text per account; of equal names the first record counts."""
    # Fixed values in this and the next three functions: templates of the facts.
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    details = truncate(F.coalesce("details", F.lit("No details provided")), 200)
    fact = _line(
        "Customer: ", F.col("account_name"), "\nSegment: ", text("segment"), "\nChurn Reason: ", text("primary_reason"),
        "\nSub Reason: ", text("sub_reason"), "\nARR Lost: ", money0("arr"), "\nTenure: ", one_decimal("tenure_years"),
        " years\nProducts: ", F.regexp_replace(text("products_rollup"), "\n", ", "), "\nCompetitor 1: ", text("competitor_1"),
        "\nCompetitor 2: ", text("competitor_2"), "\nDetails: ", details,
    )
    return table.groupBy("account_name").agg(F.min_by(fact, "account_id").alias("fact"))


def segment_facts(table: DataFrame) -> DataFrame:
    grouped = table.groupBy("segment").agg(F.count("*").alias("n"), F.avg("tenure_years").alias("t"), F.sum("arr").alias("arr"))
    named = grouped.join(ranked_text(table, "segment", "primary_reason", 3, "reasons"), "segment", "left")
    fact = _line(
        F.col("segment"), " Segment Summary:\n- Total customers: ", F.col("n"), "\n- Top churn reasons: ", F.col("reasons"),
        "\n- Average tenure: ", one_decimal("t"), " years\n- Total ARR lost: ", money0("arr"),
    )
    return named.select("segment", fact.alias("fact"))


def reason_facts(table: DataFrame) -> DataFrame:
    grouped = table.groupBy("primary_reason").agg(F.count("*").alias("n"), mean("arr", 2).alias("arr"))
    named = grouped.join(ranked_text(table, "primary_reason", "segment", None, "segments"), "primary_reason", "left")
    fact = _line(
        F.col("primary_reason"), " Churn Reason Summary:\n- Total customers: ", F.col("n"), "\n- Segments affected: ",
        F.col("segments"), "\n- Average ARR: ", money0("arr"),
    )
    return named.select("primary_reason", fact.alias("fact"))


def overall_fact(table: DataFrame) -> Column:
    """Summary of all accounts as a scalar subquery."""
    top = (
        table.groupBy("primary_reason")
        .agg(F.count("*").alias("cnt"))
        .orderBy(F.desc("cnt"), "primary_reason")
        .limit(3)
    )
    text = F.concat("primary_reason", F.lit("="), F.col("cnt").cast("string"))
    entries = F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("order"), "primary_reason", text.alias("text"))))
    reasons = top.agg(F.array_join(F.transform(entries, lambda e: e["text"]), "; ")).scalar()
    by_segment = table.filter("segment IS NOT NULL").groupBy("segment").agg(F.count("*").alias("cnt"))
    segment = F.concat("segment", F.lit("="), F.col("cnt").cast("string"))
    entries = F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("order"), "segment", segment.alias("text"))))
    segments = by_segment.agg(F.array_join(F.transform(entries, lambda e: e["text"]), "; ")).scalar()
    totals = table.agg(F.count("*").alias("n"), F.avg("tenure_years").alias("t"), F.sum("arr").alias("arr"))
    fact = _line(
        "Overall Churn Summary:\n- Total customers: ", F.col("n"), "\n- Segments: ", segments, "\n- Top 3 churn reasons: ", reasons,
        "\n- Average tenure: ", one_decimal("t"), " years\n- Total ARR lost: ", money0("arr"),
    )
    return totals.select(fact).scalar()


def golden_set(asked: DataFrame, table: DataFrame) -> DataFrame:
    """Questions with the facts they call for as ground truth, and their expected sources.

    A question is answered from the account, the segment and the reason it names, or from the
    overall summary if it names none.
    """
    subjects = (
        ("account_name", account_facts(table)),
        ("segment", segment_facts(table)),
        ("primary_reason", reason_facts(table)),
    )
    out = asked
    for i, (name, facts) in enumerate(subjects):
        named = first_mention(asked, table, name).join(facts, name)
        out = out.join(named.select("question_id", F.col("fact").alias(f"_fact{i}")), "question_id", "left")
    found = F.array_join(F.array_compact(F.array(*[f"_fact{i}" for i in range(len(subjects))])), "\n")
    out = out.withColumn(
        "ground_truth", F.when(F.length(found) > 0, found).otherwise(overall_fact(table))
    )
    out = materialize(out, "golden")
    contexts = out.select("question_id", "ground_truth")
    return out.join(expected_sources(asked, table, contexts), "question_id", "left").select(
        "question_id", "question", "ground_truth", "query_type", "expected_context", "difficulty"
    )


def expected_sources(asked: DataFrame, table: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """(question_id, expected_context): up to five accounts that the question names, in any case, or the reference
    context (question_id, ground_truth) names as written; else the category's sources."""
    named = mentions(asked, table, "question_id", "question", "account_name")
    if contexts is not None:
        named = named.union(mentions(contexts, table, "question_id", "ground_truth", "account_name", ignore_case=False)).distinct()
    first = top_per_group(named, "question_id", ["account_name"], MAX_SOURCES, "_rank")
    listed = first.groupBy("question_id").agg(
        F.array_join(F.array_sort(F.collect_list("account_name")), ",").alias("_named")
    )
    default = F.lit("")
    for category, sources in DEFAULT_SOURCES.items():
        default = F.when(F.col("query_type") == category, sources).otherwise(default)
    return asked.join(listed, "question_id", "left").select(
        "question_id", F.coalesce("_named", default).alias("expected_context")
    )


def profile(golden: DataFrame) -> DataFrame:
    """Per category: questions, answer lengths, and how many have one or several sources."""
    sources = F.size(F.split("expected_context", ","))
    return golden.groupBy("query_type").agg(
        F.count("*").alias("questions"),
        F.round(F.avg(F.length("ground_truth")), 4).alias("avg_length"),
        F.min(F.length("ground_truth")).cast("bigint").alias("min_length"),
        F.max(F.length("ground_truth")).cast("bigint").alias("max_length"),
        F.count_if(sources == 1).alias("one_source"),
        F.count_if(sources >= 2).alias("several_sources"),
    )
