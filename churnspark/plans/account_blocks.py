"""Check SQL of the account model."""

from churnspark.plans.registry import block

block(
    "accounts",
    """
SELECT c_custkey AS account_id, c_name AS account_name, c_mktsegment AS segment,
       a.close_date, a.first_win_date, a.arr,
       round(date_diff('day', a.first_win_date, a.close_date) / 365.25::DOUBLE, 4) AS tenure_years,
       l.o_orderpriority AS primary_reason, l.o_orderstatus AS sub_reason,
       a.close_date < (SELECT max(o_orderdate)::DATE - 180 FROM orders) AS is_churned
FROM customer
JOIN (SELECT o_custkey, max(o_orderdate)::DATE AS close_date, min(o_orderdate)::DATE AS first_win_date,
             sum(o_totalprice::DECIMAL(18,2)) AS arr
      FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey
JOIN (SELECT o_custkey, o_orderpriority, o_orderstatus,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
      FROM orders) l ON l.o_custkey = c_custkey AND l.rn = 1
""",
)
block("churned", "SELECT * FROM accounts WHERE is_churned", "accounts")
block("active", "SELECT * FROM accounts WHERE NOT is_churned", "accounts")
block(
    "products",
    """
SELECT DISTINCT o_custkey AS account_id, p_type AS product
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
""",
)
block(
    "competitors",
    """
SELECT account_id, position, s_name AS competitor FROM (
  SELECT o_custkey AS account_id, l_suppkey,
         row_number() OVER (PARTITION BY o_custkey ORDER BY
           sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2))) DESC, l_suppkey) AS position
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)
JOIN supplier ON s_suppkey = l_suppkey WHERE position <= 2
""",
)
block(
    "churn_table",
    """
SELECT c.*, r.products_rollup, k.competitor_1, k.competitor_2, d.details
FROM churned c
LEFT JOIN (SELECT account_id, string_agg(product, chr(10) ORDER BY product) AS products_rollup
           FROM products GROUP BY 1) r USING (account_id)
LEFT JOIN (SELECT account_id, max(competitor) FILTER (position = 1) AS competitor_1,
                  max(competitor) FILTER (position = 2) AS competitor_2
           FROM competitors GROUP BY 1) k USING (account_id)
LEFT JOIN (SELECT conv_id AS account_id, arg_min(text, turn) AS details
           FROM conversations WHERE role = 'user' GROUP BY 1) d USING (account_id)
""",
    "churned",
    "products",
    "competitors",
)
block(
    "ev",
    """
SELECT event_id, user_id AS account_id, ts, event_type, value,
       CAST(json_extract_string(props, '$.k') AS INT) % 8 AS feature
FROM events
""",
)
block("clock", "SELECT max(ts) AS now FROM ev", "ev")
