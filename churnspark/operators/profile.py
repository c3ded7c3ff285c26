"""Churn profiles: frequencies, sums, spreads, seasonality and data quality."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from churnspark.session import materialize
from churnspark.operators.ranking import counts, exact_quantiles, top_per_group, with_share


def mean(c, places: int = 4) -> Column:
    """Mean of a numeric column as a rounded double."""
    return F.round(F.avg(F.col(c).cast("double")), places)


def total(c) -> Column:
    return F.sum(c).cast("double")


def ranked_text(df: DataFrame, group, item: str, n: int | None, out: str) -> DataFrame:
    """``item=count`` of the ``n`` most frequent items per group (of all, without ``n``), as one text.

    Ties go to the smaller name. A text holds one entry per distinct item, not per row.
    """
    keys = [group] if isinstance(group, str) else list(group)
    top = counts(df.filter(F.col(item).isNotNull()), *keys, item)
    if n is not None:
        top = top_per_group(top, keys, [F.desc("cnt"), item], n, "_rank")
    text = F.concat(F.col(item), F.lit("="), F.col("cnt").cast("string")).alias("text")
    entry = F.struct((-F.col("cnt")).alias("order"), F.col(item).alias("item"), text)
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"])
    return top.groupBy(*keys).agg(F.array_join(listed, "; ").alias(out))


def churn_patterns(churned: DataFrame, rivals: DataFrame, n: int = 5) -> DataFrame:
    """Per segment: accounts, top reasons and competitors, mean tenure and ARR, total ARR."""
    per_segment = churned.groupBy("segment").agg(
        F.count("*").alias("customer_count"),
        mean("tenure_years").alias("avg_tenure"),
        mean("arr").alias("avg_arr_lost"),
        total("arr").alias("total_arr_lost"),
    )
    lost_to = churned.select("account_id", "segment").join(rivals, "account_id")
    return (
        per_segment.join(ranked_text(churned, "segment", "primary_reason", n, "top_reasons"), "segment", "left")
        .join(ranked_text(lost_to, "segment", "competitor", n, "top_competitors"), "segment", "left")
        .select(
            "segment",
            "customer_count",
            "top_reasons",
            "top_competitors",
            "avg_tenure",
            "avg_arr_lost",
            "total_arr_lost",
        )
    )


def frequency(df: DataFrame, c: str) -> DataFrame:
    """Value, count and share of the non-null values of one column."""
    return with_share(counts(df, c))


def summary(df: DataFrame) -> DataFrame:
    """Totals and spread of ARR and tenure over all rows, exact medians included.

    Reads its input several times, so pass a table, not a long plan.
    """
    plain = df.agg(
        F.count("*").alias("accounts"),
        total("arr").alias("total_arr"),
        mean("arr").alias("avg_arr"),
        F.min("arr").cast("double").alias("min_arr"),
        F.max("arr").cast("double").alias("max_arr"),
        mean("tenure_years").alias("avg_tenure"),
        F.min("tenure_years").alias("min_tenure"),
        F.max("tenure_years").alias("max_tenure"),
    )
    # Both columns are one table of (column, value), so their medians are found in the same rounds.
    stacked = df.select(F.col("arr").cast("double").alias("arr"), F.col("tenure_years").cast("double").alias("tenure_years"))
    stacked = stacked.unpivot([], ["arr", "tenure_years"], "_column", "_value")
    medians = exact_quantiles(stacked, "_value", {"median": 0.5}, ("_column",))

    def median(c):
        return F.round(F.max(F.when(F.col("_column") == c, F.col("median"))), 4)

    both = medians.agg(F.struct(median("arr").alias("arr"), median("tenure_years").alias("tenure"))).scalar()
    return plain.withColumn("median_arr", both["arr"]).withColumn("median_tenure", both["tenure"])


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that have NULLs, with count and percent, in one pass."""
    nulls = df.agg(
        F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    return (
        nulls.unpivot("_n", columns, "column_name", "missing")
        .filter("missing > 0")
        .select("column_name", "missing", F.round(F.col("missing") * 100.0 / F.col("_n"), 4).alias("percent"))
    )


def product_pairs(products: DataFrame) -> DataFrame:
    """How many accounts used both products, for every pair of products.

    Accounts are first reduced to their distinct product sets with a count, so
    pairs are formed once per set, not once per account. A set is at most the
    catalogue of product types.
    """
    sets = (
        products.groupBy("account_id")
        .agg(F.array_sort(F.collect_list("product")).alias("items"))
        .groupBy("items")
        .agg(F.count("*").alias("cnt"))
    )
    paired = sets.select(F.posexplode("items").alias("at", "product_a"), "items", "cnt").select(
        "product_a", F.explode(F.expr("slice(items, at + 2, size(items))")).alias("product_b"), "cnt"
    )
    return paired.groupBy("product_a", "product_b").agg(F.sum("cnt").alias("accounts"))


def product_combinations(products: DataFrame, least: int, largest: int = 3) -> DataFrame:
    """(items, accounts): product combinations of two to ``largest`` products that at least ``least`` accounts used.

    Frequent itemsets by a distributed prefix tree: accounts are dealt to the products they may end a combination with,
    and no pair or triple is formed that too few accounts have. ``least`` bounds the result.
    """
    sets = materialize(products.groupBy("account_id").agg(F.array_sort(F.collect_set("product")).alias("items")), "product-sets")
    accounts = sets.count()
    if not accounts:
        return sets.select("items", F.lit(0).cast("bigint").alias("accounts"))
    # Just below the wanted share, so that rounding up gives ``least`` itself.
    found = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / accounts)).fit(sets).freqItemsets
    kept = found.where((F.col("freq") >= least) & F.size("items").between(2, largest))
    return kept.select(F.array_sort("items").alias("items"), F.col("freq").alias("accounts"))


#: Size of a rank sketch; a rank is within RANK_ERROR of the wanted share of rows with 99 % confidence.
SKETCH_K, RANK_ERROR = 200, 0.0166


def quantile_sketches(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, sketch, n): a mergeable rank sketch of a number per group, in one pass; NULLs are left out."""
    number = F.col(value).cast("double")
    return df.where(number.isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(number, SKETCH_K).alias("sketch"), F.count("*").alias("n"))


def merged_quantiles(sketches: DataFrame, probs: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """Quantiles of the union of stored sketches, per group: values whose ranks are within RANK_ERROR of the wanted."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("_merged"), F.sum("n").alias("n"))
    found = [F.kll_sketch_get_quantile_double("_merged", F.lit(p)).alias(label) for label, p in probs.items()]
    return merged.where("n > 0").select(*by, "n", *found)


TENURE_BANDS = ("<1 year", "1-2 years", ">2 years")


def tenure_band(c) -> Column:
    return (
        F.when(F.col(c) < 1, TENURE_BANDS[0]).when(F.col(c) <= 2, TENURE_BANDS[1]).otherwise(TENURE_BANDS[2])
    )


def quality_checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule (an aggregate that yields a boolean): name and verdict."""
    verdicts = df.agg(*[rule.alias(name) for name, rule in rules.items()])
    return verdicts.unpivot([], list(rules), "check_name", "passed").select(
        "check_name", F.coalesce("passed", F.lit(False)).alias("passed")
    )
