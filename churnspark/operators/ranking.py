"""Top-n, shares of a total, and exact quantiles without a one-task group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from churnspark.operators.sizing import fits
from churnspark.session import materialize


def top_per_group(df: DataFrame, group, order, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each group. Each task keeps at most ``n`` rows per group
    before the shuffle (WindowGroupLimit), so a hot group costs no more than others."""
    window = W.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window).cast("bigint")).filter(F.col(rank) <= n)


def counts(df: DataFrame, *keys: str, name: str = "cnt") -> DataFrame:
    """Rows per key, NULL keys left out."""
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def with_share(counted: DataFrame, name: str = "cnt", share: str = "share") -> DataFrame:
    """Share of the total, with the total taken by a scalar subquery over the grouped rows."""
    total = counted.agg(F.sum(name).cast("double")).scalar()
    return counted.withColumn(share, F.round(F.col(name) / total, 6))


#: Equal-width cells per level of the search for a rank.
CELLS = 4096
#: Values of one interval that are sorted in one task; larger intervals are cut into cells again.
SORTED = 16_384


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """Linearly interpolated quantiles per group, exact, for groups of any size and any spread of values.

    Every wanted rank lies in an interval of values, at first the whole group's. An interval with more than ``SORTED``
    rows is cut into ``CELLS`` equal cells, counted by partial aggregation, and the cell that covers the rank becomes
    the interval, with the smallest and largest value really in it; so one far outlier costs one more round, not a
    large group. Intervals of one value are settled. No task sorts more than ``SORTED`` rows or sums more than
    ``CELLS`` cells of an interval. Reads its input once per round, so pass a table, not a long plan.
    """
    keys = list(by) or ["_all"]
    source = df if by else df.withColumn("_all", F.lit(0))
    values = source.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    wanted = []
    for label, p in probs.items():
        position = (F.col("_cnt") - 1) * F.lit(float(p))
        beyond = position - F.floor(position)
        for rank, weight in ((F.floor(position), 1 - beyond), (F.ceil(position), beyond)):
            wanted.append(F.struct(F.lit(label).alias("_label"), rank.cast("long").alias("_rank"), weight.alias("_w")))
    ends = [F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_cnt")]
    sought = materialize(values.groupBy(*keys).agg(*ends).select("*", F.inline(F.array(*wanted))), "ranks")
    interval = [*keys, "_lo", "_hi"]
    while True:
        largest = sought.filter("_lo < _hi").agg(F.max("_cnt")).first()[0] or 0
        if largest <= SORTED:
            break
        sought = materialize(_narrowed(values, sought, keys, interval), "ranks")
    settled = sought.filter("_lo = _hi").withColumn("_v", F.col("_lo"))
    if largest:
        at = (F.row_number().over(W.partitionBy(*interval).orderBy("_v")) - 1).cast("long")
        ranked = _inside(values, sought, keys, interval).withColumn("_rank", at)
        found = sought.filter("_lo < _hi").join(ranked, [*interval, "_rank"])
        settled = settled.select(*keys, "_label", "_w", "_v").unionByName(found.select(*keys, "_label", "_w", "_v"))
    out = settled.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("_label") == label, F.col("_v") * F.col("_w"))).alias(label) for label in probs]
    )
    return out if by else out.drop("_all")


def _inside(values: DataFrame, sought: DataFrame, keys: list[str], interval: list[str]) -> DataFrame:
    """Values that lie in an interval that is still open; intervals of one group are equal or disjoint."""
    open_ = sought.filter("_lo < _hi").select(*interval).distinct()
    open_ = F.broadcast(open_) if fits(open_) else open_
    return values.join(open_, keys).filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))


def _narrowed(values: DataFrame, sought: DataFrame, keys: list[str], interval: list[str]) -> DataFrame:
    """Replace every open interval by the cell of it that covers its rank."""
    share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
    cell = F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).cast("int")
    cells = (
        _inside(values, sought, keys, interval)
        .groupBy(*interval, cell.alias("_cell"))
        .agg(F.min("_v").alias("_first"), F.max("_v").alias("_last"), F.count("*").alias("_in"))
    )
    before = F.sum("_in").over(W.partitionBy(*interval).orderBy("_cell")) - F.col("_in")
    covering = (
        sought.filter("_lo < _hi")
        .drop("_cnt")
        .join(cells.withColumn("_before", before), interval)
        .filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_in")))
    )
    narrowed = covering.select(
        *keys, F.col("_first").alias("_lo"), F.col("_last").alias("_hi"), F.col("_in").alias("_cnt"), "_label",
        (F.col("_rank") - F.col("_before")).alias("_rank"), "_w",
    )
    return sought.filter("_lo = _hi").unionByName(narrowed)
