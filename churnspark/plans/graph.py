"""Entity graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnspark.functions import columns as C
from churnspark.operators import graph as G
from churnspark.plans import account_blocks, profile  # noqa: F401 - blocks
from churnspark.plans.registry import block, query, sql
from churnspark.session import materialize
from churnspark.sources import sinks, tables as T

block(
    "edges",
    """
SELECT account_name AS src, 'SEGMENT:' || segment AS dst, 'BELONGS_TO' AS relationship, 'customer_segment' AS type,
       NULL::DATE AS churn_date FROM churned
UNION ALL SELECT account_name, 'REASON:' || primary_reason, 'CHURNED_DUE_TO', 'customer_reason', close_date FROM churned
UNION ALL SELECT account_name, 'SUBREASON:' || sub_reason, 'CHURNED_DUE_TO', 'customer_subreason', NULL FROM churned
UNION ALL SELECT account_name, 'COMPETITOR:' || competitor, 'SWITCHED_TO', 'customer_competitor', NULL
          FROM churned JOIN competitors USING (account_id)
UNION ALL SELECT account_name, 'PRODUCT:' || product, 'USED_PRODUCT', 'customer_product', NULL
          FROM churned JOIN products USING (account_id)
""",
    "churned",
    "competitors",
    "products",
)
block(
    "nodes",
    """
SELECT account_name AS id, 'Customer' AS type, account_name AS name, segment, tenure_years, arr::DOUBLE AS arr_lost,
       close_date AS churn_date, first_win_date, coalesce(products_rollup, '') AS products,
       coalesce(details, '') AS churn_narrative, NULL AS reason_type FROM churn_table
UNION ALL
SELECT DISTINCT dst, CASE relationship WHEN 'BELONGS_TO' THEN 'Segment' WHEN 'CHURNED_DUE_TO' THEN 'ChurnReason'
                     WHEN 'SWITCHED_TO' THEN 'Competitor' ELSE 'Product' END,
       regexp_replace(dst, '^[A-Z]+:', ''), NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       CASE WHEN dst LIKE 'REASON:%' THEN 'primary' WHEN dst LIKE 'SUBREASON:%' THEN 'sub' END FROM edges
""",
    "churn_table",
    "edges",
)


#: Tables that the churn table is made of.
GRAPH_TABLES = ("customer", "orders", "lineitem", "part", "supplier", "conversations")


def graph(wh):
    """Nodes and edges, written once per session."""

    def make():
        table = materialize(T.churn_table(wh), "accounts")
        return materialize(G.nodes(table), "nodes"), materialize(G.edges(table), "edges")

    return wh.kept("graph", GRAPH_TABLES, make)


@query("GR1 GR3", sql("SELECT * FROM nodes", "nodes"))
def graph_nodes(wh):
    return graph(wh)[0]


@query("GR2 GR3", sql("SELECT * FROM edges", "edges"))
def graph_edges(wh):
    return graph(wh)[1]


STATS_SQL = sql(
    """
SELECT 'node' AS kind, type AS name, count(*) AS cnt FROM nodes GROUP BY 2
UNION ALL SELECT 'node', 'all', count(*) FROM nodes
UNION ALL SELECT 'edge', relationship, count(*) FROM edges GROUP BY 2
UNION ALL SELECT 'edge', 'all', count(*) FROM edges
""",
    "nodes",
    "edges",
)


@query("AGG17", STATS_SQL)
def graph_stats(wh):
    return G.statistics(*graph(wh))


@query("SNK5", STATS_SQL)
def graph_saved_and_loaded(wh):
    path = sinks.save_graph(*graph(wh))
    return G.statistics(*sinks.load_graph(wh.spark, path))


@query("SNK5 FLT5", sql("SELECT type, count(DISTINCT name) AS entities FROM nodes GROUP BY 1", "nodes"))
def entity_sets(wh):
    return graph(wh)[0].groupBy("type").agg(F.countDistinct("name").alias("entities"))


@query("FLT5", sql("SELECT DISTINCT name FROM nodes WHERE type = 'ChurnReason'", "nodes"))
def churn_reason_entities(wh):
    return G.entities_of_type(graph(wh)[0], "ChurnReason")


def linked(dst):
    return sql(f"SELECT src AS customer FROM edges WHERE dst = '{dst}'", "edges")


@query("FLT4", linked("REASON:1-URGENT"))
def customers_by_reason(wh):
    return G.customers_linked_to(*graph(wh), ["REASON:1-URGENT", "SUBREASON:1-URGENT"])


@query("FLT4", linked("COMPETITOR:Supplier#000000007"))
def customers_by_competitor(wh):
    return G.customers_linked_to(*graph(wh), ["COMPETITOR:Supplier#000000007"])


@query("FLT4", linked("SEGMENT:BUILDING"))
def customers_by_segment(wh):
    return G.customers_linked_to(*graph(wh), ["SEGMENT:BUILDING"])


NEIGHBOURS = (
    "SELECT src, dst, relationship, edges.type, edges.churn_date, nodes.type AS node_type, name "
    "FROM edges JOIN nodes ON id = dst"
)


@query("JN3", sql(NEIGHBOURS, "edges", "nodes"))
def neighbours(wh):
    return G.neighbours(*graph(wh))


@query("JN3", sql(NEIGHBOURS + " WHERE relationship = 'CHURNED_DUE_TO'", "edges", "nodes"))
def neighbours_by_relationship(wh):
    return G.neighbours(*graph(wh), "CHURNED_DUE_TO")


@query(
    "JN7",
    sql(
        """
SELECT competitor, count(DISTINCT account_id) AS accounts FROM lost_to
WHERE account_id IN (SELECT account_id FROM products WHERE product = 'PROMO') GROUP BY 1
""",
        "lost_to",
        "products",
    ),
)
def competitor_wins_for_product(wh):
    return G.competitors_of_product(graph(wh)[1], "PROMO")


@query(
    "AGG18",
    sql("SELECT competitor, count(*) AS accounts FROM lost_to GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "lost_to"),
)
def competitor_losses(wh):
    return G.competitor_losses(graph(wh)[1])


@query(
    "AGG5",
    sql(
        """
SELECT segment, count(*) AS customer_count, round(avg(tenure_years), 4) AS avg_tenure,
       round(avg(arr::DOUBLE), 4) AS avg_arr_lost, sum(arr)::DOUBLE AS total_arr_lost FROM churned GROUP BY 1
""",
        "churned",
    ),
)
def graph_patterns(wh):
    return G.patterns(*graph(wh))


@query(
    "PRJ8",
    sql("SELECT account_id, product FROM lost_products", "lost_products"),
)
def products_from_rollup(wh):
    rolled = T.product_rollup(wh, T.account_lines(wh, wh.churned))
    return rolled.select("account_id", F.explode(C.split_list("products_rollup")).alias("product"))


@query(
    "PRJ8",
    sql("SELECT account_id, products_rollup AS product FROM churn_table WHERE products_rollup IS NOT NULL", "churn_table"),
)
def products_compatible(wh):
    """Only ``;`` and ``,`` split: a newline-separated cell stays one product."""
    rolled = T.product_rollup(wh, T.account_lines(wh, wh.churned))
    return rolled.select(
        "account_id", F.explode(C.split_list("products_rollup", C.PRODUCT_DELIMITERS_COMPAT)).alias("product")
    )
