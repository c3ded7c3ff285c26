"""Check SQL of activity, scores and reports."""

import re

from churnspark.operators import reports as R
from churnspark.plans import account_blocks  # noqa: F401 - blocks this one needs
from churnspark.plans.registry import block

DAYS = 7

block(
    "activity",
    f"""
SELECT account_id,
       count(*) FILTER (inside AND event_type = 'error') AS tickets,
       count(*) FILTER (inside AND event_type IN ('click', 'view'))::DOUBLE
         / nullif(count(*) FILTER (inside), 0) AS engagement_score,
       count(DISTINCT feature) FILTER (inside) / 8.0::DOUBLE AS adoption_rate,
       count(*) FILTER (inside AND event_type = 'error' AND ts > now - INTERVAL {DAYS * 12} HOURS) AS newer,
       date_diff('day', max(ts) FILTER (event_type IN ('click', 'view'))::DATE, max(now)::DATE) AS last_engagement_days
FROM (SELECT ev.*, now, ts > now - INTERVAL {DAYS} DAYS AS inside FROM ev, clock) GROUP BY 1
""",
    "ev",
    "clock",
)
block(
    "shares",
    "SELECT segment, count(*)::DOUBLE / (SELECT count(segment) FROM churned) AS segment_share FROM churned "
    "WHERE segment IS NOT NULL GROUP BY 1",
    "churned",
)
block(
    "inputs",
    """
SELECT a.*, coalesce(segment_share, 0.3) AS segment_share, coalesce(tickets, 2) AS tickets,
       coalesce(engagement_score, 0.5) AS engagement_score, coalesce(adoption_rate, 0.5) AS adoption_rate,
       coalesce(last_engagement_days, 15) AS last_engagement_days,
       CASE WHEN newer > tickets - newer THEN 'increasing' WHEN newer < tickets - newer THEN 'decreasing'
            ELSE 'stable' END AS trend
FROM active a LEFT JOIN shares USING (segment) LEFT JOIN activity USING (account_id)
""",
    "active",
    "shares",
    "activity",
)
block(
    "healthy",
    """
SELECT *, greatest(0.0, least(100.0, 50.0::DOUBLE + (segment_share * 100 - 50) * 0.5::DOUBLE
         + CASE WHEN tenure_years < 1 THEN 20 WHEN tenure_years < 2 THEN 10 ELSE 0 END
         + CASE WHEN engagement_score < 0.3 THEN 25 WHEN engagement_score < 0.5 THEN 15 ELSE 0 END
         + CASE WHEN tickets > 5 THEN 15 ELSE 0 END)) AS health_raw,
       concat_ws('; ',
         CASE WHEN tenure_years < 1 THEN 'New customer (< 1 year)'
              WHEN tenure_years < 2 THEN 'Relatively new (< 2 years)' END,
         CASE WHEN engagement_score < 0.3 THEN 'Very low engagement'
              WHEN engagement_score < 0.5 THEN 'Below average engagement' END,
         CASE WHEN tickets > 5 THEN 'High support volume (' || tickets || ' tickets/month)' END) AS risk_factors
FROM inputs
""",
    "inputs",
)
block(
    "scores",
    """
SELECT *, round(risk_raw, 1) AS risk_score, round(health_raw, 1) AS health_score,
       CASE WHEN health_raw >= 80 THEN 'Critical' WHEN health_raw >= 60 THEN 'High'
            WHEN health_raw >= 40 THEN 'Medium' ELSE 'Low' END AS risk_level,
       CASE WHEN risk_raw >= 80 THEN 14 WHEN risk_raw >= 60 THEN 29 ELSE 60 END AS days_until_churn,
       CASE WHEN tickets > 5 THEN 'Support issues' WHEN engagement_score < 0.5 THEN 'Low engagement'
            WHEN adoption_rate < 0.4 THEN 'Feature gaps' WHEN tenure_years < 1 THEN 'Poor onboarding'
            ELSE 'Product fit concerns' END AS risk_reason
FROM (SELECT *, greatest(15.0, least(95.0, segment_share * 100 * 0.3::DOUBLE + health_raw * 0.7::DOUBLE
                + greatest(0.0, (3.0 - tenure_years) / 3.0) * 5)) AS risk_raw FROM healthy)
""",
    "healthy",
)


def percent0(x):
    return f"(floor(({x}) * 100 + 0.5)::BIGINT || '%')"


def one(x):
    return f"round({x}, 1)::DECIMAL(18,1)::VARCHAR"


def title(x):
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


ADOPTED = percent0("adoption_rate")
TARGET = percent0("least(adoption_rate + 0.25, 0.95)")

#: What the report templates are filled with.
FACTS = {
    "customer": "account_name", "segment": "segment", "arr": "'$' || format('{:,}', arr::DECIMAL(28,0)::BIGINT)",
    "tenure": one("tenure_years"), "risk": one("risk_score"), "category": "category", "urgency": "urgency_level",
    "timeline": "urgency_days", "days": "days_until_churn", "renewal": "(days_until_churn - 30)", "trend": title("trend"),
    "reason": "risk_reason", "reason_title": title("risk_reason"), "reason_lower": "lower(risk_reason)", "adoption": ADOPTED,
    "target": TARGET, "tickets": "tickets", "quiet": "last_engagement_days",
}


def filled(template, **more):
    """SQL text of a template."""
    values = FACTS | more
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(f"({values[p]})" if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts))


block(
    "graded",
    """
SELECT *, CASE WHEN risk_score >= 80 THEN 'critical (80%+)' WHEN risk_score >= 60 THEN 'high (60-79%)' ELSE 'moderate' END AS category,
  CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH' ELSE 'MEDIUM' END AS urgency_level,
  CASE WHEN risk_score >= 80 THEN 7 WHEN risk_score >= 60 THEN 14 ELSE 30 END AS urgency_days
FROM scores
""",
    "scores",
)
block(
    "advised",
    f"""
SELECT *,
  list_filter([
    CASE WHEN tenure_years < 1 THEN '**New Customer Alert**: Only ' || {one("tenure_years")} || ' years with us - critical retention period'
         WHEN tenure_years < 2 THEN '**Early Stage Customer**: ' || {one("tenure_years")} || ' years tenure - still in relationship-building phase' END,
    CASE WHEN adoption_rate < 0.4 THEN '**Low Product Adoption**: Only ' || {ADOPTED} || ' feature usage - major churn predictor'
         WHEN adoption_rate < 0.6 THEN '**Moderate Product Adoption**: ' || {ADOPTED} || ' feature usage - room for improvement' END,
    CASE WHEN tickets > 5 THEN '**High Support Volume**: ' || tickets || ' tickets in 30 days - indicates friction or dissatisfaction'
         WHEN tickets > 3 THEN '**Elevated Support Activity**: ' || tickets || ' tickets recently - requires attention' END,
    CASE WHEN last_engagement_days > 30 THEN '**Disengaged**: No interaction in ' || last_engagement_days || ' days - relationship at risk'
         WHEN last_engagement_days > 14 THEN '**Declining Engagement**: Last contact ' || last_engagement_days || ' days ago - proactive outreach needed' END,
    CASE WHEN trend = 'increasing' THEN '**Worsening Trend**: Risk is increasing - immediate action required'
         WHEN trend = 'stable' THEN '**Stable Risk**: Current interventions maintaining status - need breakthrough strategies' END
  ], lambda x: x IS NOT NULL) AS insights,
  list_transform(list_filter([
    {filled(R.CONCERN)}, CASE WHEN adoption_rate < 0.6 THEN {filled(R.ADOPTION)} END, CASE WHEN tickets > 3 THEN {filled(R.SUPPORT)} END,
    CASE WHEN last_engagement_days > 14 THEN {filled(R.RELATIONSHIP)} END, {filled(R.VALUE)}
  ], lambda x: x IS NOT NULL), lambda x, i: i || '. ' || x) AS recommendations
FROM graded
""",
    "graded",
)
LISTED = {
    "insights": "CASE WHEN len(insights) > 0 THEN array_to_string(list_transform(insights, lambda x: '- ' || x), chr(10)) "
    f"ELSE '{R.NO_INSIGHT}' END",
    "recommendations": "array_to_string(recommendations, chr(10) || chr(10))",
}
block("reports", f"SELECT *, {filled(R.REPORT, **LISTED, context=chr(39) * 2)} AS report FROM advised", "advised")
