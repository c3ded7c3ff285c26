"""The account model as views over the warehouse tables.

An account is a customer with orders. Its newest order stands for its state: the
account has churned if that order is older than ``gap_days`` before the newest
order of all. The newest order's priority and status stand for the outcome
reason and sub reason, ordered part types for products, and the two suppliers
with the highest revenue for the competitors.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from churnspark.operators.ranking import top_per_group
from churnspark.session import kept, materialize, version

GAP_DAYS = 180
FEATURES = 8


class Warehouse:
    """Parquet tables under one folder, one file or folder per table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def kept(self, name: str, tables: tuple[str, ...], make):
        """``make()``, called once per session for these tables as they are now; what it writes is read by later queries."""
        versions = tuple(version(self.spark, f"{self.root}/{table}.parquet") for table in tables)
        return kept(self.spark, (name, self.root, versions), make)

    @cached_property
    def accounts(self) -> DataFrame:
        return accounts(self)

    @cached_property
    def churned(self) -> DataFrame:
        return self.accounts.filter("is_churned")

    @cached_property
    def active(self) -> DataFrame:
        return self.accounts.filter(~F.col("is_churned"))

    @cached_property
    def events(self) -> DataFrame:
        return events(self)


def accounts(wh: Warehouse, gap_days: int = GAP_DAYS) -> DataFrame:
    """One row per account; one shuffle of the orders."""
    orders = wh.table("orders")
    per_account = orders.groupBy("o_custkey").agg(
        F.max("o_orderdate").cast("date").alias("close_date"),
        F.min("o_orderdate").cast("date").alias("first_win_date"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("arr"),
        F.max_by(
            F.struct("o_orderpriority", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")
        ).alias("last"),
    )
    cutoff = orders.select(F.date_sub(F.max("o_orderdate").cast("date"), gap_days)).scalar()
    tenure = F.datediff("close_date", "first_win_date") / F.lit(365.25)
    return (
        wh.table("customer")
        .join(per_account, F.col("c_custkey") == F.col("o_custkey"))
        .select(
            F.col("c_custkey").alias("account_id"),
            F.col("c_name").alias("account_name"),
            F.col("c_mktsegment").alias("segment"),
            "close_date",
            "first_win_date",
            "arr",
            F.round(tenure, 4).alias("tenure_years"),
            F.col("last.o_orderpriority").alias("primary_reason"),
            F.col("last.o_orderstatus").alias("sub_reason"),
            (F.col("close_date") < cutoff).alias("is_churned"),
        )
    )


def account_lines(wh: Warehouse, accounts: DataFrame | None = None) -> DataFrame:
    """Line items with their account (account_id, l_partkey, l_suppkey, revenue), of the given accounts only.

    Accounts restrict the orders before these meet the line items.
    """
    revenue = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    orders = wh.table("orders").select("o_orderkey", F.col("o_custkey").alias("account_id"))
    if accounts is not None:
        orders = orders.join(accounts.select("account_id"), "account_id", "left_semi")
    lines = wh.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", revenue.alias("revenue"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "account_id", "l_partkey", "l_suppkey", "revenue"
    )


def account_products(wh: Warehouse, level: str = "p_type", accounts: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Distinct (account_id, product), products being the part's type or brand."""
    lines = account_lines(wh, accounts) if lines is None else lines
    parts = wh.table("part").select("p_partkey", F.col(level).alias("product"))
    return (
        lines.select("account_id", "l_partkey")
        .distinct()
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select("account_id", "product")
        .distinct()
    )


def account_competitors(wh: Warehouse, n: int = 2, accounts: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """(account_id, position, competitor): the ``n`` suppliers with the highest revenue."""
    lines = account_lines(wh, accounts) if lines is None else lines
    spent = lines.groupBy("account_id", "l_suppkey").agg(F.sum("revenue").alias("revenue"))
    ranked = top_per_group(spent, "account_id", [F.desc("revenue"), "l_suppkey"], n, "position")
    suppliers = wh.table("supplier").select("s_suppkey", F.col("s_name").alias("competitor"))
    return ranked.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "account_id", "position", "competitor"
    )


def competitor_columns(wh: Warehouse, lines: DataFrame | None = None) -> DataFrame:
    """account_id, competitor_1, competitor_2."""
    return (
        account_competitors(wh, lines=lines)
        .groupBy("account_id")
        .agg(*[F.max(F.when(F.col("position") == i, F.col("competitor"))).alias(f"competitor_{i}") for i in (1, 2)])
    )


def product_rollup(wh: Warehouse, lines: DataFrame | None = None) -> DataFrame:
    """account_id, products_rollup: product names, one per line, in name order.

    A list holds at most the catalogue's product types, whatever the account's size.
    """
    return (
        account_products(wh, lines=lines)
        .groupBy("account_id")
        .agg(F.array_join(F.array_sort(F.collect_list("product")), "\n").alias("products_rollup"))
    )


def narratives(wh: Warehouse) -> DataFrame:
    """account_id, details: the first user turn of the account's conversation."""
    return (
        wh.table("conversations")
        .filter("role = 'user'")
        .groupBy(F.col("conv_id").alias("account_id"))
        .agg(F.min_by("text", "turn").alias("details"))
    )


def churn_table(wh: Warehouse) -> DataFrame:
    """Churned accounts with products, competitors and narrative: the account export's columns.

    Accounts and the line items of their orders are written once; products and competitors are both read off these.
    """
    churned = materialize(wh.churned, "churned")
    lines = materialize(account_lines(wh, churned), "lines")
    return (
        churned.join(product_rollup(wh, lines), "account_id", "left")
        .join(competitor_columns(wh, lines), "account_id", "left")
        .join(narratives(wh), "account_id", "left")
    )


def events(wh: Warehouse) -> DataFrame:
    """Account events with the feature they touched, 0 to 7."""
    return wh.table("events").select(
        "event_id",
        F.col("user_id").alias("account_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        "value",
        F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(FEATURES)).alias("feature"),
    )


def latest_event(wh: Warehouse):
    """Newest event time, the "now" of every activity feature, as a scalar subquery."""
    return wh.events.agg(F.max("ts")).scalar()
