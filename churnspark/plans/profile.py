"""Churn profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnspark.functions import columns as C
from churnspark.operators import profile as P
from churnspark.operators.ranking import counts, exact_quantiles, top_per_group, with_share
from churnspark.plans import account_blocks  # noqa: F401 - defines the blocks
from churnspark.plans.registry import block, query, sql
from churnspark.session import materialize
from churnspark.sources import tables as T


def ranked_block(name, source, group, item, n, out, *needs):
    block(
        name,
        f"""
SELECT {group}, string_agg({item} || '=' || cnt, '; ' ORDER BY cnt DESC, {item}) AS {out}
FROM (SELECT {group}, {item}, count(*) AS cnt,
             row_number() OVER (PARTITION BY {group} ORDER BY count(*) DESC, {item}) AS rn
      FROM {source} WHERE {item} IS NOT NULL GROUP BY 1, 2) {f"WHERE rn <= {n}" if n else ""} GROUP BY 1
""",
        *needs,
    )


ranked_block("seg_reasons", "churned", "segment", "primary_reason", 5, "top_reasons", "churned")
ranked_block("seg_reasons3", "churned", "segment", "primary_reason", 3, "top_reasons", "churned")
block("lost_to", "SELECT segment, account_id, competitor FROM churned JOIN competitors USING (account_id)", "churned", "competitors")
ranked_block("seg_rivals", "lost_to", "segment", "competitor", 5, "top_competitors", "lost_to")


@query(
    "AGG5 WIN1",
    sql(
        """
SELECT segment, count(*) AS customer_count, max(top_reasons) AS top_reasons, max(top_competitors) AS top_competitors,
       round(avg(tenure_years), 4) AS avg_tenure, round(avg(arr::DOUBLE), 4) AS avg_arr_lost,
       sum(arr)::DOUBLE AS total_arr_lost
FROM churned LEFT JOIN seg_reasons USING (segment) LEFT JOIN seg_rivals USING (segment) GROUP BY segment
""",
        "churned",
        "seg_reasons",
        "seg_rivals",
    ),
)
def segment_churn_patterns(wh):
    return P.churn_patterns(wh.churned, T.account_competitors(wh, accounts=wh.churned).drop("position"))


def share_sql(c, source="churned"):
    return sql(
        f"SELECT {c}, count(*) AS cnt, round(count(*) / (SELECT count({c}) FROM {source})::DOUBLE, 6) AS share "
        f"FROM {source} WHERE {c} IS NOT NULL GROUP BY 1",
        source,
    )


@query("AGG1 WIN3", share_sql("segment"))
def segment_share(wh):
    return P.frequency(wh.churned, "segment")


@query("AGG1 WIN3", share_sql("primary_reason"))
def reason_share(wh):
    return P.frequency(wh.churned, "primary_reason")


@query(
    "AGG2",
    sql("SELECT primary_reason, count(*) AS cnt FROM churned GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "churned"),
)
def reason_top(wh):
    return counts(wh.churned, "primary_reason").orderBy(F.desc("cnt"), "primary_reason").limit(10)


def figures(wh):
    """The numbers of the churned accounts, written once for the several passes of exact quantiles."""
    return materialize(wh.churned.select("segment", "arr", "tenure_years"), "figures")


@query(
    "AGG3 AGG4",
    sql(
        """
SELECT count(*) AS accounts, sum(arr)::DOUBLE AS total_arr, round(avg(arr::DOUBLE), 4) AS avg_arr,
       min(arr)::DOUBLE AS min_arr, max(arr)::DOUBLE AS max_arr, round(avg(tenure_years), 4) AS avg_tenure,
       min(tenure_years) AS min_tenure, max(tenure_years) AS max_tenure,
       round(quantile_cont(arr::DOUBLE, 0.5), 4) AS median_arr,
       round(quantile_cont(tenure_years, 0.5), 4) AS median_tenure
FROM churned
""",
        "churned",
    ),
)
def tenure_arr_stats(wh):
    return P.summary(figures(wh))


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


@query(
    "AGG3",
    sql(
        "SELECT "
        + ", ".join(f"round(quantile_cont(arr::DOUBLE, {p}), 4) AS {n}" for n, p in QUARTILES.items())
        + " FROM churned",
        "churned",
    ),
)
def arr_quartiles(wh):
    found = exact_quantiles(figures(wh), "arr", QUARTILES)
    return found.select(*[F.round(q, 4).alias(q) for q in QUARTILES])


@query(
    "AGG3",
    sql(
        "SELECT segment, "
        + ", ".join(f"round(quantile_cont(arr::DOUBLE, {p}), 4) AS {n}" for n, p in QUARTILES.items())
        + " FROM churned GROUP BY 1",
        "churned",
    ),
)
def arr_quartiles_by_segment(wh):
    found = exact_quantiles(figures(wh), "arr", QUARTILES, ("segment",))
    return found.select("segment", *[F.round(q, 4).alias(q) for q in QUARTILES])


@query(
    "AGG10",
    sql(
        """
SELECT (SELECT count(DISTINCT account_id) FROM churned) AS customers,
       (SELECT count(DISTINCT segment) FROM churned) AS segments,
       (SELECT count(DISTINCT primary_reason) FROM churned) AS reasons,
       (SELECT count(DISTINCT competitor) FROM lost_to) AS competitors
""",
        "churned",
        "lost_to",
    ),
)
def distinct_counts(wh):
    rivals = T.account_competitors(wh, accounts=wh.churned)
    n_rivals = rivals.agg(F.countDistinct("competitor")).scalar()
    return wh.churned.agg(
        F.countDistinct("account_id").alias("customers"),
        F.countDistinct("segment").alias("segments"),
        F.countDistinct("primary_reason").alias("reasons"),
    ).withColumn("competitors", n_rivals)


PROFILE_COLUMNS = [
    "account_name", "segment", "close_date", "first_win_date", "arr", "tenure_years", "primary_reason",
    "sub_reason", "products_rollup", "competitor_1", "competitor_2", "details",
]


@query(
    "AGG11",
    sql(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing, "
            f"round(count(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / count(*), 4) AS percent FROM churn_table"
            for c in PROFILE_COLUMNS
        )
        + ") WHERE missing > 0",
        "churn_table",
    ),
)
def missing_profile(wh):
    return P.missing(T.churn_table(wh), PROFILE_COLUMNS)


@query(
    "AGG12",
    sql(
        """
SELECT count(*) AS accounts, count(*) FILTER (length(details) > 0) AS with_details,
       round(avg(length(details)) FILTER (length(details) > 0), 4) AS avg_length
FROM churned LEFT JOIN (SELECT conv_id AS account_id, arg_min(text, turn) AS details
                        FROM conversations WHERE role = 'user' GROUP BY 1) USING (account_id)
""",
        "churned",
    ),
)
def text_quality(wh):
    filled = F.when(F.length("details") > 0, F.length("details"))
    return wh.churned.join(T.narratives(wh), "account_id", "left").agg(
        F.count("*").alias("accounts"), F.count(filled).alias("with_details"), F.round(F.avg(filled), 4).alias("avg_length")
    )


@query(
    "AGG13 AGG19",
    sql(
        """
SELECT segment, count(*) AS customers, max(top_reasons) AS top_reasons, round(avg(tenure_years), 4) AS avg_tenure,
       sum(arr)::DOUBLE AS total_arr,
       segment || ': ' || count(*) || ' customers, top reason: '
         || coalesce(split_part(max(top_reasons), '=', 1), 'N/A') AS key_insight
FROM churned LEFT JOIN seg_reasons3 USING (segment) GROUP BY segment
""",
        "churned",
        "seg_reasons3",
    ),
)
def segment_summary(wh):
    top_reason = F.coalesce(F.split_part("top_reasons", F.lit("="), F.lit(1)), F.lit("N/A"))
    return (
        wh.churned.groupBy("segment")
        .agg(F.count("*").alias("customers"), P.mean("tenure_years").alias("avg_tenure"), P.total("arr").alias("total_arr"))
        .join(P.ranked_text(wh.churned, "segment", "primary_reason", 3, "top_reasons"), "segment", "left")
        .withColumn(
            "key_insight",
            F.concat("segment", F.lit(": "), F.col("customers"), F.lit(" customers, top reason: "), top_reason),
        )
    )


ranked_block("reason_segments", "churned", "primary_reason", "segment", None, "segments_affected", "churned")


@query(
    "AGG14",
    sql(
        """
SELECT primary_reason, count(*) AS customers, max(segments_affected) AS segments_affected,
       round(avg(arr::DOUBLE), 4) AS avg_arr
FROM churned JOIN reason_segments USING (primary_reason) GROUP BY 1
""",
        "churned",
        "reason_segments",
    ),
)
def reason_summary(wh):
    return (
        wh.churned.groupBy("primary_reason")
        .agg(F.count("*").alias("customers"), P.mean("arr").alias("avg_arr"))
        .join(P.ranked_text(wh.churned, "primary_reason", "segment", None, "segments_affected"), "primary_reason")
    )


@query(
    "AGG15 WIN4",
    sql(
        """
SELECT (SELECT count(*) FROM churned) AS customers,
       (SELECT string_agg(primary_reason || '=' || cnt, '; ' ORDER BY cnt DESC, primary_reason) FROM
         (SELECT primary_reason, count(*) AS cnt FROM churned GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)) AS top_reasons,
       (SELECT string_agg(account_name, '; ' ORDER BY arr DESC, account_id) FROM
         (SELECT * FROM churned ORDER BY arr DESC, account_id LIMIT 10)) AS top_customers,
       (SELECT string_agg(segment || '=' || cnt, '; ' ORDER BY cnt DESC, segment) FROM
         (SELECT segment, count(*) AS cnt FROM churned WHERE segment IS NOT NULL GROUP BY 1)) AS segments,
       (SELECT string_agg(competitor, '; ' ORDER BY competitor) FROM
         (SELECT DISTINCT competitor FROM lost_to ORDER BY competitor LIMIT 10)) AS competitors,
       (SELECT round(avg(tenure_years), 4) FROM churned) AS avg_tenure,
       (SELECT sum(arr)::DOUBLE FROM churned) AS total_arr
""",
        "churned",
        "lost_to",
    ),
)
def overall_summary(wh):
    reasons = counts(wh.churned, "primary_reason").orderBy(F.desc("cnt"), "primary_reason").limit(3)
    reason_text = F.concat("primary_reason", F.lit("="), F.col("cnt").cast("string"))
    largest = wh.churned.orderBy(F.desc("arr"), "account_id").limit(10)

    segments = counts(wh.churned, "segment")
    segment_text = F.concat("segment", F.lit("="), F.col("cnt").cast("string"))
    # The first ten by name stand for the competitors; how many there are is in distinct_counts.
    rivals = T.account_competitors(wh, accounts=wh.churned).select("competitor").distinct().orderBy("competitor").limit(10)

    def joined(df, order, text):
        entries = F.array_sort(F.collect_list(F.struct(*order, text.alias("text"))))
        return df.agg(F.array_join(F.transform(entries, lambda e: e["text"]), "; ")).scalar()

    return wh.churned.agg(
        F.count("*").alias("customers"),
        P.mean("tenure_years").alias("avg_tenure"),
        P.total("arr").alias("total_arr"),
    ).select(
        "*",
        joined(reasons, [(-F.col("cnt")).alias("o"), F.col("primary_reason")], reason_text).alias("top_reasons"),
        joined(largest, [(-F.col("arr")).alias("o"), F.col("account_id")], F.col("account_name")).alias("top_customers"),
        joined(segments, [(-F.col("cnt")).alias("o"), F.col("segment")], segment_text).alias("segments"),
        joined(rivals, [F.col("competitor").alias("o")], F.col("competitor")).alias("competitors"),
    )


@query(
    "AGG24",
    sql(
        """
SELECT * FROM (
  SELECT unnest(['has_rows', 'names_unique', 'names_present', 'arr_positive', 'tenure_not_negative', 'dates_in_order',
                 'five_segments', 'reasons_present', 'competitors_mostly_present']) AS check_name,
         unnest([count(*) > 0, count(DISTINCT account_name) = count(*), bool_and(account_name IS NOT NULL),
                 bool_and(arr > 0), bool_and(tenure_years >= 0), bool_and(first_win_date <= close_date),
                 count(DISTINCT segment) = 5, bool_and(primary_reason IS NOT NULL),
                 avg((competitor_1 IS NOT NULL)::INT) >= 0.9]) AS passed
  FROM churn_table)
""",
        "churn_table",
    ),
)
def dq_checks(wh):
    has = lambda c: F.col(c).isNotNull()
    return P.quality_checks(
        T.churn_table(wh),
        {
            "has_rows": F.count("*") > 0,
            "names_unique": F.countDistinct("account_name") == F.count("*"),
            "names_present": F.bool_and(has("account_name")),
            "arr_positive": F.bool_and(F.col("arr") > 0),
            "tenure_not_negative": F.bool_and(F.col("tenure_years") >= 0),
            "dates_in_order": F.bool_and(F.col("first_win_date") <= F.col("close_date")),
            "five_segments": F.countDistinct("segment") == 5,
            "reasons_present": F.bool_and(has("primary_reason")),
            "competitors_mostly_present": F.avg(has("competitor_1").cast("int")) >= 0.9,
        },
    )


@query(
    "AGG25",
    sql(
        """
SELECT category, count(*) AS sources, count(*) FILTER (last_sync IS NOT NULL) AS connected,
       sum(coalesce(records, 0))::BIGINT AS records_synced
FROM (
  SELECT event_type AS source, 'analytics' AS category, max(ts) AS last_sync, count(*) AS records
  FROM ev WHERE event_type <> 'error' GROUP BY 1
  UNION ALL SELECT event_type, 'support', max(ts), count(*) FROM ev WHERE event_type = 'error' GROUP BY 1
  UNION ALL SELECT role, 'crm', NULL, count(*) FROM conversations GROUP BY 1
  UNION ALL SELECT o_orderstatus, 'billing', max(o_orderdate), count(*) FROM orders GROUP BY 1)
GROUP BY 1
""",
        "ev",
    ),
)
def source_rollup(wh):
    def source(df, c, category, last):
        return df.groupBy(F.col(c).alias("source")).agg(last.alias("last_sync"), F.count("*").alias("records")).withColumn(
            "category", category
        )

    from_events = source(
        wh.events,
        "event_type",
        F.when(F.col("source") == "error", "support").otherwise("analytics"),
        F.max("ts"),
    )
    billed = source(
        wh.table("orders"), "o_orderstatus", F.lit("billing"), F.max(F.col("o_orderdate").cast("timestamp"))
    )
    talked = source(wh.table("conversations"), "role", F.lit("crm"), F.max(F.lit(None).cast("timestamp")))
    return (
        from_events.unionByName(billed)
        .unionByName(talked)
        .groupBy("category")
        .agg(
            F.count("*").alias("sources"),
            F.count("last_sync").alias("connected"),
            F.sum(F.coalesce("records", F.lit(0))).alias("records_synced"),
        )
    )


block("lost_products", "SELECT c.*, product FROM churned c JOIN products USING (account_id)", "churned", "products")


@query(
    "AGG26",
    sql(
        """
SELECT a.product AS product_a, b.product AS product_b, count(*) AS accounts
FROM lost_products a JOIN lost_products b ON a.account_id = b.account_id AND a.product < b.product GROUP BY 1, 2
""",
        "lost_products",
    ),
)
def product_pairs(wh):
    return P.product_pairs(T.account_products(wh, accounts=wh.churned))


@query(
    "AGG26",
    sql(
        """
SELECT items, accounts FROM (
  SELECT a.product || '|' || b.product AS items, count(*) AS accounts
  FROM lost_products a JOIN lost_products b ON a.account_id = b.account_id AND a.product < b.product GROUP BY 1
  UNION ALL
  SELECT a.product || '|' || b.product || '|' || c.product, count(*)
  FROM lost_products a JOIN lost_products b ON a.account_id = b.account_id AND a.product < b.product
  JOIN lost_products c ON c.account_id = a.account_id AND b.product < c.product GROUP BY 1)
WHERE accounts >= (SELECT greatest(2, (count(DISTINCT account_id) + 9) // 10) FROM lost_products)
""",
        "lost_products",
    ),
)
def product_combinations(wh):
    """Pairs and triples of products that a tenth of the churned accounts used together."""
    products = materialize(T.account_products(wh, accounts=wh.churned), "products")
    least = max(2, -(-products.select("account_id").distinct().count() // 10))
    found = P.product_combinations(products, least)
    return found.select(F.array_join("items", "|").alias("items"), "accounts")


@query(
    "AGG3",
    sql(
        "SELECT label, true AS within_bound, (SELECT count(*) FROM orders) AS n FROM (VALUES ('q05'), ('q25'), ('q50'), ('q75'), ('q95')) v(label)",
    ),
)
def order_value_sketches(wh):
    """Rank sketches of order values per month, stored, then merged: is the share of orders below each quantile within
    the sketch's error of the wanted share?"""
    probs = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
    orders = wh.table("orders").select("o_orderdate", F.col("o_totalprice").cast("double").alias("price"))
    stored = materialize(P.quantile_sketches(orders.withColumn("month", F.trunc("o_orderdate", "month")), "price", ["month"]), "sketches")
    values = P.merged_quantiles(stored, probs).first()
    shares = orders.agg(F.count("*").alias("n"), *[(F.count_if(F.col("price") <= values[q]) / F.count("price")).alias(q) for q in probs])
    wanted = F.create_map(*[F.lit(x) for pair in probs.items() for x in pair])
    return shares.unpivot("n", list(probs), "label", "share").select("label", (F.abs(F.col("share") - wanted[F.col("label")]) <= P.RANK_ERROR).alias("within_bound"), "n")


@query(
    "AGG27",
    sql(
        """
SELECT date_trunc('month', close_date)::DATE AS month,
       year(close_date) || '-Q' || quarter(close_date) AS quarter,
       count(*) AS churned, sum(arr)::DOUBLE AS arr_lost
FROM churned GROUP BY 1, 2
""",
        "churned",
    ),
)
def churn_by_month(wh):
    quarter = F.concat(F.year("close_date"), F.lit("-Q"), F.quarter("close_date"))
    return wh.churned.groupBy(
        F.trunc("close_date", "month").alias("month"), quarter.alias("quarter")
    ).agg(F.count("*").alias("churned"), P.total("arr").alias("arr_lost"))


@query(
    "AGG28",
    sql("SELECT date_trunc('week', close_date)::DATE AS week, count(*) AS churned FROM churned GROUP BY 1", "churned"),
)
def churn_by_week(wh):
    return wh.churned.groupBy(F.date_trunc("week", "close_date").cast("date").alias("week")).agg(
        F.count("*").alias("churned")
    )


@query(
    "AGG29",
    sql(
        """
SELECT CASE WHEN tenure_years < 1 THEN '<1 year' WHEN tenure_years <= 2 THEN '1-2 years' ELSE '>2 years' END AS band,
       count(*) AS churned, sum(arr)::DOUBLE AS arr_lost FROM churned GROUP BY 1
""",
        "churned",
    ),
)
def tenure_bands(wh):
    return wh.churned.groupBy(P.tenure_band("tenure_years").alias("band")).agg(
        F.count("*").alias("churned"), P.total("arr").alias("arr_lost")
    )


@query(
    "AGG30",
    sql(
        """
SELECT primary_reason, round(avg(tenure_years), 4) AS avg_tenure,
       round(avg(tenure_years) - (SELECT avg(tenure_years) FROM churned), 4) AS versus_all
FROM churned GROUP BY 1
""",
        "churned",
    ),
)
def reason_tenure(wh):
    overall = wh.churned.agg(F.avg("tenure_years")).scalar()
    return wh.churned.groupBy("primary_reason").agg(F.avg("tenure_years").alias("t")).select(
        "primary_reason", F.round("t", 4).alias("avg_tenure"), F.round(F.col("t") - overall, 4).alias("versus_all")
    )


@query("AGG31", sql("SELECT segment, product, count(*) AS accounts FROM lost_products GROUP BY 1, 2", "lost_products"))
def product_by_segment(wh):
    used = wh.churned.select("account_id", "segment").join(T.account_products(wh, accounts=wh.churned), "account_id")
    return counts(used, "segment", "product", name="accounts")


@query("AGG32", sql("SELECT competitor, segment, count(*) AS accounts FROM lost_to GROUP BY 1, 2", "lost_to"))
def competitor_by_segment(wh):
    lost = wh.churned.select("account_id", "segment").join(T.account_competitors(wh, accounts=wh.churned), "account_id")
    return counts(lost, "competitor", "segment", name="accounts")


@query(
    "AGG33",
    sql("SELECT segment, primary_reason, count(*) AS accounts FROM churned GROUP BY 1, 2", "churned"),
)
def segment_reason(wh):
    return counts(wh.churned, "segment", "primary_reason", name="accounts")


@query(
    "AGG34",
    sql("SELECT round(avg(date_diff('day', first_win_date, close_date)), 4) AS avg_days FROM churned", "churned"),
)
def time_to_churn(wh):
    return wh.churned.agg(F.round(F.avg(F.datediff("close_date", "first_win_date")), 4).alias("avg_days"))


@query(
    "AGG35",
    sql(
        """
SELECT segment, round(avg(arr::DOUBLE), 4) AS avg_arr, sum(arr)::DOUBLE AS total_arr,
       segment = (SELECT segment FROM churned GROUP BY 1 ORDER BY sum(arr) DESC, segment LIMIT 1) AS is_largest
FROM churned GROUP BY 1
""",
        "churned",
    ),
)
def segment_arr(wh):
    grouped = wh.churned.groupBy("segment").agg(P.mean("arr").alias("avg_arr"), F.sum("arr").alias("t"))
    largest = grouped.orderBy(F.desc("t"), "segment").limit(1).select("segment").scalar()
    return grouped.select(
        "segment", "avg_arr", F.col("t").cast("double").alias("total_arr"), (F.col("segment") == largest).alias("is_largest")
    )


@query(
    "WIN4 PRJ20",
    sql(
        """
SELECT account_id, account_name, arr::DOUBLE AS arr, '$' || format('{:,}', arr::DECIMAL(28,0)::BIGINT) AS arr_text,
       primary_reason FROM churned ORDER BY churned.arr DESC, account_id LIMIT 10
""",
        "churned",
    ),
)
def largest_accounts(wh):
    return (
        wh.churned.orderBy(F.desc("arr"), "account_id")
        .limit(10)
        .select("account_id", "account_name", F.col("arr").cast("double").alias("arr"), C.money0("arr").alias("arr_text"), "primary_reason")
    )


@query(
    "WIN5",
    sql(
        """
SELECT account_id, account_name, tenure_years, primary_reason FROM churned ORDER BY tenure_years, account_id LIMIT 1
""",
        "churned",
    ),
)
def shortest_tenure(wh):
    return (
        wh.churned.orderBy("tenure_years", "account_id")
        .limit(1)
        .select("account_id", "account_name", "tenure_years", "primary_reason")
    )


@query(
    "WIN1",
    sql(
        """
SELECT segment, account_id, rank, arr::DOUBLE AS arr FROM (
  SELECT *, row_number() OVER (PARTITION BY segment ORDER BY arr DESC, account_id) AS rank FROM churned) WHERE rank <= 3
""",
        "churned",
    ),
)
def largest_per_segment(wh):
    top = top_per_group(wh.churned, "segment", [F.desc("arr"), "account_id"], 3)
    return top.select("segment", "account_id", "rank", F.col("arr").cast("double").alias("arr"))


@query(
    "SET3 PRJ3",
    sql(
        """
SELECT DISTINCT competitor FROM (SELECT competitor_1 AS competitor FROM churn_table UNION ALL
                                 SELECT competitor_2 FROM churn_table) WHERE competitor IS NOT NULL
""",
        "churn_table",
    ),
)
def competitor_union(wh):
    both = F.explode(F.array("competitor_1", "competitor_2")).alias("competitor")
    return (
        wh.churned.select("account_id")
        .join(T.competitor_columns(wh, T.account_lines(wh, wh.churned)), "account_id")
        .select(both)
        .select(C.null_if_missing("competitor").alias("competitor"))
        .filter("competitor IS NOT NULL")
        .distinct()
    )


@query(
    "FLT6",
    sql(
        "SELECT account_id, close_date FROM churned WHERE close_date BETWEEN DATE '2000-07-01' AND DATE '2000-09-30'",
        "churned",
    ),
)
def churned_in_quarter(wh):
    return wh.churned.filter(F.col("close_date").between("2000-07-01", "2000-09-30")).select("account_id", "close_date")


@query(
    "FLT7",
    sql(
        "SELECT account_id, primary_reason FROM churned WHERE primary_reason IS DISTINCT FROM '1-URGENT'",
        "churned",
    ),
)
def not_for_reason(wh):
    return wh.churned.filter(~F.col("primary_reason").eqNullSafe("1-URGENT")).select("account_id", "primary_reason")


@query(
    "FLT8",
    sql(
        """
SELECT account_id FROM accounts WHERE segment = 'BUILDING'
  AND NOT EXISTS (SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
                  WHERE o_custkey = account_id AND p_brand = 'Brand#7')
""",
        "accounts",
    ),
)
def never_used_product(wh):
    users = T.account_products(wh, "p_brand").filter("product = 'Brand#7'")
    return wh.accounts.filter("segment = 'BUILDING'").join(users, "account_id", "left_anti").select("account_id")
