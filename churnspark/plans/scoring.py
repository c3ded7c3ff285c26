"""Account scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnspark.functions import columns as C
from churnspark.operators import reports as R, scoring as S
from churnspark.plans.registry import block, query, sql
from churnspark.plans.scoring_blocks import ADOPTED, DAYS, one, percent0
from churnspark.sources import tables as T


def scored(wh):
    return S.score_accounts(wh.active, wh.churned, wh.events, T.latest_event(wh), DAYS)


def reported(wh):
    return R.with_reports(scored(wh))


@query(
    "SCR6",
    sql(
        """
SELECT account_id, tickets, round(engagement_score, 6) AS engagement_score, adoption_rate, last_engagement_days,
       CASE WHEN newer > tickets - newer THEN 'increasing' WHEN newer < tickets - newer THEN 'decreasing'
            ELSE 'stable' END AS trend FROM activity
""",
        "activity",
    ),
)
def activity_features(wh):
    found = S.activity(wh.events, T.latest_event(wh), DAYS)
    return found.withColumn("engagement_score", F.round("engagement_score", 6))


@query(
    "SCR1 SCR2 SCR3 JN2 PRJ18",
    sql(
        "SELECT account_id, segment, round(segment_share, 6) AS segment_share, tenure_years, health_score, risk_level, "
        "risk_factors, 0.85::DOUBLE AS confidence FROM scores",
        "scores",
    ),
)
def health_scores(wh):
    return scored(wh).select(
        "account_id", "segment", F.round("segment_share", 6).alias("segment_share"), "tenure_years", "health_score",
        "risk_level", F.array_join("risk_factors", "; ").alias("risk_factors"), "confidence",
    )


@query("SCR4 SCR5", sql("SELECT account_id, risk_score, days_until_churn, trend, risk_reason FROM scores", "scores"))
def portfolio_risk(wh):
    return scored(wh).select("account_id", "risk_score", "days_until_churn", "trend", "risk_reason")


@query(
    "FLT1 WIN7",
    sql(
        "SELECT account_id, account_name, risk_score FROM scores WHERE risk_score >= 40 "
        "ORDER BY risk_score DESC, account_id LIMIT 10",
        "scores",
    ),
)
def at_risk(wh):
    return S.at_risk(scored(wh), 40.0).select("account_id", "account_name", "risk_score")


@query("WIN7", sql("SELECT account_id, risk_score FROM scores ORDER BY risk_score DESC, account_id", "scores"))
def risk_ranking(wh):
    """Every account in order of risk: a range-partitioned sort."""
    return scored(wh).select("account_id", "risk_score").orderBy(F.desc("risk_score"), "account_id")


def dashboard_sql(threshold):
    return sql(
        f"""
SELECT count(*) FILTER (risk_score >= {threshold}) AS total_at_risk,
       count(*) FILTER (risk_score >= greatest(80, {threshold})) AS critical_risk_count,
       coalesce(sum(arr) FILTER (risk_score >= {threshold}), 0)::DOUBLE AS total_arr_at_risk,
       coalesce(round(avg(days_until_churn) FILTER (risk_score >= {threshold}), 1), 0)::DOUBLE AS avg_days_to_churn,
       count(*) AS total_active_customers FROM scores
""",
        "scores",
    )


@query("AGG6", dashboard_sql(60))
def dashboard_stats(wh):
    return S.dashboard(scored(wh))


@query("AGG6", dashboard_sql(40))
def dashboard_stats_low(wh):
    return S.dashboard(scored(wh), 40.0)


@query(
    "AGG7",
    sql(
        """
SELECT unnest(['Critical (80-100%)', 'High (60-79%)', 'Medium (40-59%)', 'Low (0-39%)']) AS band,
       unnest([count(*) FILTER (risk_score >= 80), count(*) FILTER (risk_score >= 60 AND risk_score < 80),
               count(*) FILTER (risk_score >= 40 AND risk_score < 60), count(*) FILTER (risk_score < 40)]) AS accounts
FROM scores
""",
        "scores",
    ),
)
def risk_bands(wh):
    return S.risk_bands(scored(wh))


@query("AGG8", sql("SELECT segment, sum(arr)::DOUBLE AS arr, count(*) AS accounts FROM scores GROUP BY 1", "scores"))
def arr_by_segment(wh):
    return S.arr_by_segment(scored(wh))


@query(
    "AGG9 WIN3",
    sql(
        """
SELECT risk_reason, count(*) AS accounts,
       floor(count(*) / (SELECT count(*) FROM scores)::DOUBLE * 100 + 0.5)::BIGINT AS percentage
FROM scores GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6
""",
        "scores",
    ),
)
def risk_reasons(wh):
    return S.risk_reasons(scored(wh))


@query(
    "SCR7 PRJ18",
    sql(
        """
SELECT account_id, ((SELECT now FROM clock)::DATE - ((w + 1) * 7)::INT)::DATE AS week_start, coalesce(events, 0) AS events,
       CASE WHEN events > 0 THEN round(greatest(0.1, least(1.0, engaged::DOUBLE / events)), 4) END AS engagement_score
FROM (SELECT DISTINCT account_id, unnest(range(13)) AS w FROM ev)
LEFT JOIN (SELECT account_id, date_diff('day', ts::DATE, now::DATE) // 7 AS w, count(*) AS events,
                  count(*) FILTER (event_type IN ('click', 'view')) AS engaged
           FROM ev, clock GROUP BY 1, 2) USING (account_id, w)
""",
        "ev",
        "clock",
    ),
)
def engagement_weekly(wh):
    return S.engagement_weekly(wh.events, T.latest_event(wh))


@query(
    "SCR8",
    sql(
        f"""
SELECT account_id, {list(S.FEATURE_NAMES)}[feature + 1] AS feature,
       round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY account_id), 4) AS usage_rate,
       max(ts)::DATE AS last_used FROM ev GROUP BY account_id, ev.feature
""",
        "ev",
    ),
)
def feature_usage(wh):
    return S.feature_usage(wh.events)


@query(
    "SCR9",
    sql(
        """
SELECT account_id, event_id, ts::DATE AS opened, CASE WHEN risk_score > 70 THEN 'High' ELSE 'Medium' END AS priority
FROM ev JOIN scores USING (account_id), clock WHERE event_type = 'error' AND ts > now - INTERVAL 30 DAYS
""",
        "scores",
        "ev",
        "clock",
    ),
)
def ticket_history(wh):
    return S.ticket_history(wh.events, scored(wh), T.latest_event(wh))


@query(
    "SCR10",
    sql(
        "SELECT account_id, floor(risk_score + 0.5) / 100 AS churn_probability, days_until_churn, "
        "greatest(0, days_until_churn - 7) AS lower, days_until_churn + 14 AS upper FROM scores",
        "scores",
    ),
)
def predictions(wh):
    return scored(wh).select("account_id", R.prediction().alias("p")).select("account_id", "p.*")


@query(
    "SCR11",
    sql(
        """
SELECT account_id, unnest(['Engagement Score', 'Support Tickets', 'Feature Adoption', 'Tenure']) AS factor,
       unnest([CASE WHEN risk_score > 70 THEN 'High' ELSE 'Medium' END, CASE WHEN tickets > 5 THEN 'High' ELSE 'Low' END,
               CASE WHEN adoption_rate < 0.5 THEN 'Medium' ELSE 'Low' END,
               CASE WHEN tenure_years < 1 THEN 'High' ELSE 'Low' END]) AS impact,
       unnest([0.35, 0.20, 0.25, 0.20]::DOUBLE[]) AS weight
FROM scores
""",
        "scores",
    ),
)
def contributing_factors(wh):
    return scored(wh).select("account_id", F.inline(R.contributing_factors()))


@query(
    "SCR12",
    sql(
        """
SELECT account_id, CASE WHEN risk_score > 70 THEN 'Poor' WHEN risk_score > 50 THEN 'Fair' ELSE 'Good' END AS engagement,
       CASE WHEN adoption_rate < 0.4 THEN 'Low' WHEN adoption_rate < 0.7 THEN 'Medium' ELSE 'High' END AS product_usage,
       CASE WHEN tickets > 5 THEN 'At Risk' ELSE 'Normal' END AS support_health,
       CASE WHEN last_engagement_days > 30 THEN 'Weak' WHEN last_engagement_days > 14 THEN 'Moderate'
            ELSE 'Strong' END AS relationship_strength
FROM scores
""",
        "scores",
    ),
)
def health_indicators(wh):
    return scored(wh).select("account_id", *[c.alias(n) for n, c in R.health_indicators().items()])


@query(
    "SCR13 PRJ15 PRJ17",
    sql(
        """
SELECT account_id, unnest(range(1, 4)) AS position,
       unnest([CASE WHEN risk_score >= 80 THEN 'Critical' WHEN risk_score >= 60 THEN 'High' ELSE 'Medium' END,
               'High', 'Medium']) AS priority,
       unnest(['[' || CASE WHEN risk_score >= 80 THEN 'Critical' WHEN risk_score >= 60 THEN 'High' ELSE 'Medium' END
                 || '] Schedule executive call to address ' || lower(risk_reason),
               '[High] Conduct product training session',
               '[Medium] Share success stories from similar customers']) AS action_text,
       unnest([strftime(now::DATE + CASE WHEN risk_score >= 80 THEN 7 ELSE 14 END, '%Y-%m-%d'),
               strftime(now::DATE + 14, '%Y-%m-%d'), strftime(now::DATE + 21, '%Y-%m-%d')]) AS deadline,
       unnest(['Customer Success Manager', 'Customer Success Team', 'Account Manager']) AS owner
FROM scores, clock
""",
        "scores",
        "clock",
    ),
)
def recommended_actions(wh):
    actions = scored(wh).select("account_id", R.recommended_actions(T.latest_event(wh)).alias("actions"))
    texts = actions.withColumn("texts", R.prioritised_texts(F.col("actions")))
    return texts.select("account_id", F.posexplode("actions").alias("at", "a"), "texts").select(
        "account_id", (F.col("at") + 1).cast("bigint").alias("position"), "a.priority", "a.deadline", "a.owner",
        F.col("texts")[F.col("at")].alias("action_text"),
    )


@query(
    "SCR14",
    sql("SELECT account_id, category, urgency_level AS level, urgency_days AS days FROM reports", "reports"),
)
def urgency(wh):
    return reported(wh).select("account_id", "urgency.*")


@query("SCR15", sql("SELECT account_id, unnest(insights) AS insight FROM reports", "reports"))
def insights(wh):
    return reported(wh).select("account_id", F.explode("insights").alias("insight"))


@query("SCR16", sql("SELECT account_id, unnest(recommendations) AS recommendation FROM reports", "reports"))
def recommendations(wh):
    return reported(wh).select("account_id", F.explode("recommendations").alias("recommendation"))


block(
    "insight_rows",
    f"""
SELECT account_id, unnest([
  account_name || ' shows ' || {one("risk_score")} || '% churn risk (' || category || ') with ' || days_until_churn || ' days predicted',
  'Feature adoption at ' || {ADOPTED} || ' - ' || CASE WHEN adoption_rate < 0.4 THEN 'critical gap'
     WHEN adoption_rate < 0.6 THEN 'needs improvement' ELSE 'acceptable' END,
  'Support load: ' || tickets || ' tickets/month - ' || CASE WHEN tickets > 5 THEN 'high' WHEN tickets > 3 THEN 'elevated' ELSE 'normal' END,
  'Engagement status: ' || last_engagement_days || ' days since last contact - '
     || CASE WHEN last_engagement_days > 30 THEN 'disengaged' WHEN last_engagement_days > 14 THEN 'declining' ELSE 'active' END,
  'Risk trend is ' || trend || ' - ' || CASE WHEN trend = 'increasing' THEN 'immediate intervention required' ELSE 'monitoring required' END
]) AS key_insight FROM reports
""",
    "reports",
)


@query("SCR17", sql("SELECT * FROM insight_rows", "insight_rows"))
def key_insights(wh):
    return reported(wh).select("account_id", F.explode("key_insights").alias("key_insight"))


@query(
    "SCR17 PRJ11",
    sql(
        f"""
SELECT account_id,
  unnest(['customer-' || lower(replace(account_name, ' ', '-')), 'segment-' || lower(segment) || '-patterns']) AS citation_id,
  unnest(['live_customer_data', 'historical_pattern_analysis']) AS type,
  unnest([account_name, NULL]) AS customer, segment,
  unnest([{one("risk_score")} || '%', NULL]) AS churn_risk, unnest([NULL, 'Based on historical churn data analysis']) AS sample_size,
  unnest([{one("tenure_years")} || 'yr tenure, ' || {ADOPTED} || ' adoption, ' || tickets || ' tickets, '
            || last_engagement_days || 'd ago',
          'Customers with ' || lower(risk_reason) || ' typically churn within ' || days_until_churn || ' days']) AS content,
  unnest(['Primary Source', 'High']) AS relevance
FROM reports
""",
        "reports",
    ),
)
def account_citations(wh):
    return reported(wh).select("account_id", F.inline("citations"))


@query("SCR18", sql("SELECT account_id, report FROM reports", "reports"))
def account_reports(wh):
    return reported(wh).select("account_id", "report")


STYLE_SQL = """
list_filter([CASE WHEN contains(lower(report), 'churn') THEN 'Uses appropriate industry terminology' END,
  CASE WHEN regexp_matches(lower(report), 'recommend|suggest|strategy') THEN 'Includes actionable recommendations' END,
  CASE WHEN regexp_matches(report, '[$%]') THEN 'Contains data-driven insights' END,
  CASE WHEN len(regexp_extract_all(report, '\\S+')) > 200 THEN 'Meets comprehensive response length requirements' END
], lambda x: x IS NOT NULL)
"""


@query(
    "SCR21 SCR22",
    sql(
        f"""
SELECT account_id, array_to_string(notes, '; ') AS style_notes,
       round(0.2 + 0.15::DOUBLE * least(len(insights) / 5.0::DOUBLE, 1.0)
         + CASE WHEN length(report) > 500 THEN 0.3 ELSE 0.15 END::DOUBLE + 0.2::DOUBLE * least(2 / 5.0::DOUBLE, 1.0)
         + 0.15::DOUBLE * least(len(notes) / 4.0::DOUBLE, 1.0), 2) AS confidence
FROM (SELECT *, {STYLE_SQL} AS notes FROM reports)
""",
        "reports",
    ),
)
def report_confidence(wh):
    noted = reported(wh).withColumn("notes", R.style_notes("report"))
    return noted.select(
        "account_id",
        F.array_join("notes", "; ").alias("style_notes"),
        R.report_confidence(
            F.lit(True), F.size("insights"), F.length("report"), F.size("citations"), F.size("notes")
        ).alias("confidence"),
    )


@query(
    "SCR22",
    f"SELECT doc_id, array_to_string({STYLE_SQL.replace('report', 'text')}, '; ') AS style_notes FROM documents",
)
def document_style(wh):
    return wh.table("documents").select("doc_id", F.array_join(R.style_notes("text"), "; ").alias("style_notes"))


@query(
    "SCR19 FLT3 PRJ12",
    sql(
        f"""
SELECT question_id, coalesce(s.account_name, 'the customer') AS account_name, coalesce(segment, 'Commercial') AS segment,
       coalesce(arr, 50000)::DOUBLE AS arr, coalesce(risk_score, 65.0) AS risk_score,
       coalesce(tenure_years, 2.0) AS tenure_years, coalesce(adoption_rate, 0.5) AS adoption_rate,
       coalesce(tickets, 3) AS tickets, coalesce(last_engagement_days, 15) AS last_engagement_days,
       coalesce(days_until_churn, 30) AS days_until_churn, coalesce(trend, 'stable') AS trend,
       CASE WHEN s.account_id IS NULL THEN 0.75 ELSE 0.92 END::DOUBLE AS confidence,
       CASE WHEN s.account_id IS NULL THEN 1 ELSE 2 END AS total_sources
FROM (SELECT 'C' || c_custkey AS question_id, lower(c_name) AS key FROM customer
      UNION ALL SELECT 'S' || s_suppkey, lower(s_name) FROM supplier) q
LEFT JOIN scores s ON lower(s.account_name) = key
""",
        "scores",
    ),
)
def profile_answers(wh):
    """A retention question for every customer and supplier; suppliers and churned ones are unknown."""

    def ask(df, prefix, key, name, label):
        question = F.concat(F.lit("Create a retention plan for "), F.upper(name), F.lit(" ("), label, F.lit(")"))
        return df.select(F.concat(F.lit(prefix), F.col(key)).alias("question_id"), question.alias("question"))

    asked = ask(wh.table("customer"), "C", "c_custkey", "c_name", F.col("c_mktsegment")).unionByName(
        ask(wh.table("supplier"), "S", "s_suppkey", "s_name", F.lit("SUPPLIER"))
    )
    named = asked.withColumn("account_name", C.name_in_parentheses_question("question"))
    found = R.profile_for_questions(named, scored(wh))
    return found.withColumn("arr", F.col("arr").cast("double")).drop("risk_reason")


@query(
    "PRJ21",
    """
SELECT event_id, concat_ws('; ', CASE WHEN value < 5 THEN 'tenure_years < 0' END,
       CASE WHEN value / 100 < 0 THEN 'engagement_score < 0' WHEN value / 100 > 1 THEN 'engagement_score > 1' END) AS violations
FROM events WHERE value < 5 OR value / 100 > 1 OR value < 0
""",
)
def rejected_inputs(wh):
    """Health inputs read off raw event values; the rejected ones with their reasons."""
    raw = wh.events.select(
        "event_id",
        (F.col("value") - 5).alias("tenure_years"),
        F.lit(0.0).alias("arr"),
        (F.col("value") / 100).alias("engagement_score"),
        F.lit(0).alias("tickets"),
    )
    checked = S.validate(raw).filter(F.size("violations") > 0)
    return checked.select("event_id", F.array_join("violations", "; ").alias("violations"))


@query(
    "PRJ20",
    sql(
        f"SELECT account_id, '$' || format('{{:,}}', arr::DECIMAL(28,0)::BIGINT) AS arr_text, {percent0('risk_score / 100')} AS risk_text, "
        f"{ADOPTED} AS adoption_text FROM scores",
        "scores",
    ),
)
def formatted_scores(wh):
    return scored(wh).select(
        "account_id",
        C.money0("arr").alias("arr_text"),
        C.percent0(F.col("risk_score") / 100).alias("risk_text"),
        C.percent0("adoption_rate").alias("adoption_text"),
    )
