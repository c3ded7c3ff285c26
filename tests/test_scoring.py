"""Rule bands that the test tables do not reach, on hand-made rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from churnspark.operators import questions as Q, reports as R, scoring as S

INPUT = "account_name string, segment string, arr double, segment_share double, tenure_years double, engagement_score double, tickets bigint, adoption_rate double, last_engagement_days bigint, trend string"


def scored(spark, *rows):
    return S.portfolio(S.health(spark.createDataFrame(list(rows), INPUT)))


@pytest.mark.parametrize(
    "share, tenure, engagement, tickets, score, level, factors",
    [
        (0.24, 0.5, 0.2, 6, 97.0, "Critical", ["New customer (< 1 year)", "Very low engagement", "High support volume (6 tickets/month)"]),
        (0.28, 1.5, 0.4, 5, 64.0, "High", ["Relatively new (< 2 years)", "Below average engagement"]),
        (0.24, 3.0, 0.9, 0, 37.0, "Low", []),
        (None, None, None, None, 40.0, "Medium", []),
        (1.0, 0.5, 0.1, 9, 100.0, "Critical", ["New customer (< 1 year)", "Very low engagement", "High support volume (9 tickets/month)"]),
    ],
)
def test_health(spark, share, tenure, engagement, tickets, score, level, factors):
    row = scored(spark, ("A", "SMB", 1.0, share, tenure, engagement, tickets, 0.5, 1, "stable")).first()
    assert (row.health_score, row.risk_level, row.risk_factors) == (score, level, factors)


def test_bands_and_texts(spark):
    rows = scored(
        spark,
        ("Acme Corp", "SMB", 1234.5, 1.0, 0.5, 0.1, 9, 0.1, 40, "increasing"),
        ("Beta", "Commercial", 99.0, 0.2, 9.0, 0.9, 0, 0.9, 3, "decreasing"),
    )
    out = {r.account_name: r for r in R.with_reports(rows).select("*", *[c.alias(f"i_{n}") for n, c in R.health_indicators().items()], R.prediction().alias("p")).collect()}
    high, low = out["Acme Corp"], out["Beta"]
    assert (high.risk_score, high.days_until_churn, high.urgency.level, high.urgency.days) == (95.0, 14, "CRITICAL", 7)
    assert (low.days_until_churn, low.urgency.level, low.risk_reason) == (60, "MEDIUM", "Product fit concerns")
    assert len(high.insights) == 5 and len(low.insights) == 0
    assert [r[:2] for r in high.recommendations] == ["1.", "2.", "3.", "4.", "5."]
    assert "(currently 10%)" in high.recommendations[1] and "Target 35% within 60 days" in high.recommendations[1]
    assert len(low.recommendations) == 2
    assert "Customer metrics within normal range" in low.report
    assert (high.i_engagement, high.i_product_usage, high.i_support_health, high.i_relationship_strength) == ("Poor", "Low", "At Risk", "Weak")
    assert (low.i_engagement, low.i_product_usage, low.i_support_health, low.i_relationship_strength) == ("Good", "High", "Normal", "Strong")
    assert (high.p.lower, high.p.upper, high.p.churn_probability) == (7, 28, 0.95)
    assert high.citations[0].citation_id == "customer-acme-corp"


def test_activity_trend(spark):
    rows = [(1, "error", datetime(2024, 1, 31), 0), (1, "error", datetime(2024, 1, 30), 9 % 8), (1, "click", datetime(2024, 1, 10), 1), (2, "error", datetime(2024, 1, 2), 3), (3, "view", datetime(2023, 1, 1), 3)]
    events = spark.createDataFrame(rows, "account_id bigint, event_type string, ts timestamp, feature int")
    found = {r.account_id: r for r in S.activity(events, events.agg(F.max("ts")).scalar(), 30).collect()}
    assert (found[1].trend, found[1].tickets, found[1].adoption_rate, found[1].last_engagement_days) == ("increasing", 2, 0.25, 21)
    assert (found[2].trend, found[2].engagement_score, found[2].last_engagement_days) == ("decreasing", 0.0, None)
    assert (found[3].engagement_score, found[3].adoption_rate) == (None, 0.0)


def test_empty_dashboard(spark):
    row = S.dashboard(scored(spark, ("A", "S", 5.0, 0.2, 9.0, 0.9, 0, 0.9, 3, "stable"))).first()
    assert (row.total_at_risk, row.total_arr_at_risk, row.avg_days_to_churn, row.total_active_customers) == (0, 0.0, 0.0, 1)


def test_validation(spark):
    rows = [(1.0, 1.0, 0.5, 0), (-1.0, -2.0, 1.5, -3)]
    out = S.validate(spark.createDataFrame(rows, "tenure_years double, arr double, engagement_score double, tickets int")).collect()
    assert out[0].violations == []
    assert out[1].violations == ["tenure_years < 0", "arr < 0", "engagement_score > 1", "tickets < 0"]


def test_question_types(spark):
    asked = ["What is the churn risk, likely?", "Hello", "How do we retain them and reduce loss?", "Do they switch to a competitor?", "risk pattern"]
    df = spark.createDataFrame([(q,) for q in asked], "q string").select(Q.classify("q").alias("type"))
    method, k = Q.route("type")
    got = [tuple(r) for r in df.select("type", method, k).collect()]
    assert got == [
        ("risk_assessment", "naive", 5),
        ("pattern_analysis", "multi_query", 5),
        ("retention_strategy", "contextual_compression", 5),
        ("competitive_intel", "naive", 7),
        ("risk_assessment", "naive", 5),
    ]


def test_confidences(spark):
    row = spark.range(1).select(
        R.answer_confidence(F.lit(5), F.lit(5), F.lit(0)).alias("full"),
        R.answer_confidence(F.lit(0), F.lit(0), F.lit(2)).alias("none"),
        R.report_confidence(F.lit(True), F.lit(5), F.lit(600), F.lit(5), F.lit(4)).alias("report"),
    ).first()
    assert tuple(row) == (1.0, 0.0, 1.0)
