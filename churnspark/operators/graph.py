"""Entity graph of churned accounts as a node table and an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from churnspark.functions.columns import PRODUCT_DELIMITERS, null_if_missing, split_list

# Id prefixes, node types and relationships.
SEGMENT, REASON, SUBREASON, COMPETITOR, PRODUCT = "SEGMENT:", "REASON:", "SUBREASON:", "COMPETITOR:", "PRODUCT:"


def _relations(delimiters: str) -> Column:
    """One struct per relation an account row may have; NULL names mark absent ones."""

    def relation(prefix, name, node_type, reason_type, relationship, edge_type, churn_date=None):
        return F.struct(
            F.lit(prefix).alias("prefix"),
            name.alias("name"),
            F.lit(node_type).alias("node_type"),
            F.lit(reason_type).cast("string").alias("reason_type"),
            F.lit(relationship).alias("relationship"),
            F.lit(edge_type).alias("edge_type"),
            (F.col(churn_date) if churn_date else F.lit(None)).cast("date").alias("churn_date"),
        )

    def named(c):
        return null_if_missing(c)

    single = F.array(
        relation(SEGMENT, named("segment"), "Segment", None, "BELONGS_TO", "customer_segment"),
        relation(REASON, named("primary_reason"), "ChurnReason", "primary", "CHURNED_DUE_TO", "customer_reason", "close_date"),
        relation(SUBREASON, named("sub_reason"), "ChurnReason", "sub", "CHURNED_DUE_TO", "customer_subreason"),
        relation(COMPETITOR, named("competitor_1"), "Competitor", None, "SWITCHED_TO", "customer_competitor"),
        relation(COMPETITOR, named("competitor_2"), "Competitor", None, "SWITCHED_TO", "customer_competitor"),
    )
    products = F.transform(
        F.coalesce(split_list("products_rollup", delimiters), F.array().cast("array<string>")),
        lambda p: relation(PRODUCT, p, "Product", None, "USED_PRODUCT", "customer_product"),
    )
    return F.filter(F.concat(single, products), lambda r: r["name"].isNotNull())


def relations(accounts: DataFrame, delimiters: str = PRODUCT_DELIMITERS) -> DataFrame:
    """One row per (account, related entity) before deduplication, in one pass."""
    return accounts.select(
        F.col("account_id").alias("record"), F.col("account_name").alias("src"), F.inline(_relations(delimiters))
    ).withColumn("dst", F.concat("prefix", "name"))


def nodes(accounts: DataFrame, delimiters: str = PRODUCT_DELIMITERS) -> DataFrame:
    """Nodes by id; customers carry their attributes. The newest record of an account wins."""
    entities = (
        relations(accounts, delimiters)
        .groupBy(F.col("dst").alias("id"))
        .agg(
            F.min("node_type").alias("type"), F.min("name").alias("name"), F.min("reason_type").alias("reason_type")
        )
    )
    latest = F.row_number().over(W.partitionBy("account_name").orderBy(F.desc("account_id")))
    customers = (
        accounts.withColumn("_latest", latest)
        .filter("_latest = 1")
        .select(
            F.col("account_name").alias("id"),
            F.lit("Customer").alias("type"),
            F.col("account_name").alias("name"),
            "segment",
            F.coalesce("tenure_years", F.lit(0.0)).alias("tenure_years"),
            F.coalesce(F.col("arr").cast("double"), F.lit(0.0)).alias("arr_lost"),
            F.col("close_date").alias("churn_date"),
            "first_win_date",
            F.coalesce("products_rollup", F.lit("")).alias("products"),
            F.coalesce("details", F.lit("")).alias("churn_narrative"),
        )
    )
    return customers.unionByName(entities, allowMissingColumns=True)


def edges(accounts: DataFrame, delimiters: str = PRODUCT_DELIMITERS) -> DataFrame:
    """Edges, unique per (src, dst); the newest record wins.

    Aggregated before the shuffle: the row with the highest record id is a max of structs.
    """
    kept = F.max_by(F.struct("relationship", F.col("edge_type").alias("type"), "churn_date"), "record")
    return (
        relations(accounts, delimiters)
        .groupBy("src", "dst")
        .agg(kept.alias("e"))
        .select("src", "dst", "e.relationship", "e.type", "e.churn_date")
    )


def statistics(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Counts of nodes per type and of edges per relationship, and both totals."""

    def part(df, c, kind):
        counted = df.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("cnt"))
        whole = df.agg(F.lit("all").alias("name"), F.count("*").alias("cnt"))
        return counted.unionByName(whole).select(F.lit(kind).alias("kind"), "name", "cnt")

    return part(node_table, "type", "node").unionByName(part(edge_table, "relationship", "edge"))


def entities_of_type(node_table: DataFrame, node_type: str) -> DataFrame:
    """Distinct names of the nodes of one type."""
    return node_table.filter(F.col("type") == node_type).select("name").distinct()


def customers_linked_to(node_table: DataFrame, edge_table: DataFrame, ids: list[str]) -> DataFrame:
    """Customers with an edge to one of the given entity ids."""
    people = node_table.filter("type = 'Customer'")
    linked = edge_table.filter(F.col("dst").isin(*ids)).select("src")
    return people.join(linked, people["id"] == linked["src"], "left_semi").select(F.col("id").alias("customer"))


def neighbours(node_table: DataFrame, edge_table: DataFrame, relationship: str | None = None) -> DataFrame:
    """Every edge with the type and name of the node it leads to."""
    chosen = edge_table if relationship is None else edge_table.filter(F.col("relationship") == relationship)
    targets = node_table.select("id", F.col("type").alias("node_type"), "name")
    return chosen.join(targets, chosen["dst"] == targets["id"]).select(
        "src", "dst", "relationship", "type", "churn_date", "node_type", "name"
    )


def competitors_of_product(edge_table: DataFrame, product: str) -> DataFrame:
    """Competitors that won the users of a product: product edges meet competitor edges at the account."""
    users = edge_table.filter((F.col("relationship") == "USED_PRODUCT") & (F.col("dst") == PRODUCT + product)).select("src")
    won = edge_table.filter("relationship = 'SWITCHED_TO'").select("src", "dst")
    return (
        won.join(users, "src", "left_semi")
        .groupBy(F.substr("dst", F.lit(len(COMPETITOR) + 1)).alias("competitor"))
        .agg(F.countDistinct("src").alias("accounts"))
    )


def competitor_losses(edge_table: DataFrame, n: int | None = 10) -> DataFrame:
    """Accounts lost per competitor, most first; edges are unique per pair, so this is the in-degree."""
    lost = (
        edge_table.filter("relationship = 'SWITCHED_TO'")
        .groupBy(F.substr("dst", F.lit(len(COMPETITOR) + 1)).alias("competitor"))
        .agg(F.count("*").alias("accounts"))
        .orderBy(F.desc("accounts"), "competitor")
    )
    return lost.limit(n) if n is not None else lost


def patterns(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Per segment: accounts, mean tenure, mean and total ARR, read off the graph."""
    members = edge_table.filter("relationship = 'BELONGS_TO'").select("src", "dst")
    people = node_table.filter("type = 'Customer'").select("id", "tenure_years", "arr_lost")
    return (
        members.join(people, members["src"] == people["id"])
        .groupBy(F.substr("dst", F.lit(len(SEGMENT) + 1)).alias("segment"))
        .agg(
            F.count("*").alias("customer_count"),
            F.round(F.avg("tenure_years"), 4).alias("avg_tenure"),
            F.round(F.avg("arr_lost"), 4).alias("avg_arr_lost"),
            F.sum(F.col("arr_lost").cast("decimal(18,2)")).cast("double").alias("total_arr_lost"),
        )
    )
