"""Exact cosine top-k over vectors that are grouped round centres, without the groups that cannot hold a nearer one.

Angles between directions are a metric: a vector in a group of radius r whose centre is at angle a from the query is at
least a - r away. Groups are visited in order of that bound, a few more in each round, and those whose bound the k-th
best so far beats are skipped. Inside a visited group the same holds for the angle of each vector to the centre.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from churnspark.operators.dense import _best, _unit
from churnspark.operators.ranking import top_per_group
from churnspark.session import materialize

#: Vectors that centres are taken from: a sample by hash of the id, this large on average.
SAMPLE = 20_000
#: Most groups, and rounds of moving centres to the mean direction of the sample's vectors nearest to them.
MAX_GROUPS, MOVES = 1024, 8
#: Vectors and queries that one task compares at a time.
BLOCK_VECTORS, BLOCK_QUERIES = 16_384, 1024
#: Angles and cosines are apart by more than rounding.
MARGIN = 1e-7


@dataclass(frozen=True)
class VectorGroups:
    """``vectors`` (group, part, vec_id, unit, angle) is a written table; ``centres`` and ``radii`` are arrays of at most
    MAX_GROUPS rows; ``parts`` has the number of bounded parts of each group."""

    vectors: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    parts: np.ndarray
    dimensions: int


def _directions(cells) -> np.ndarray:
    return _unit(np.stack([np.asarray(c, np.float64) for c in cells]))


def _centres(sample: np.ndarray, groups: int) -> np.ndarray:
    """Spread out starting points, then the mean direction of the vectors nearest to each."""
    rng = np.random.default_rng(3)
    centres = sample[rng.choice(len(sample), groups, replace=False)]
    for _ in range(MOVES):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def group(corpus: DataFrame, groups: int | None = None, block: int = BLOCK_VECTORS) -> VectorGroups:
    """Group all vectors (vec_id, vec) round centres chosen from a sample; null vectors are left out.

    By default there are about as many groups as the square root of the number of vectors. A group of any size, such as
    copies of one vector, is dealt by a hash of the id into parts of about ``block``.
    """
    given = corpus.select("vec_id", "vec").where("vec IS NOT NULL")
    n = given.count()
    keep = given if n <= SAMPLE else given.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 20)) < math.ceil(SAMPLE / n * (1 << 20)))
    rows = [r["vec"] for r in keep.select("vec").collect()]
    if not rows:
        empty = corpus.sparkSession.createDataFrame([], f"group int, part int, vec_id {dict(corpus.dtypes)['vec_id']}, unit array<double>, angle double")
        return VectorGroups(empty, np.zeros((0, 0)), np.zeros(0), np.zeros(0, int), np.zeros(0, int), 0)
    sample = _directions(rows)
    centres = _centres(sample, min(groups or math.isqrt(n) or 1, MAX_GROUPS, len(sample)))
    held = corpus.sparkSession.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                unit = _directions(batch.column("vec").to_pylist())
                cosines = unit @ held.value.T
                nearest = cosines.argmax(axis=1)
                angle = np.arccos(np.clip(cosines[np.arange(len(unit)), nearest], -1, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nearest, pa.int32()), batch.column("vec_id"), pa.array(list(unit), pa.list_(pa.float64())), pa.array(angle)], ["group", "vec_id", "unit", "angle"]
                )

    kinds = f"group int, vec_id {dict(corpus.dtypes)['vec_id']}, unit array<double>, angle double"
    assigned = materialize(given.mapInArrow(assign, kinds), "assigned")
    sizes, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in assigned.groupBy("group").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect():
        sizes[r["group"]], radii[r["group"]] = r["n"], r["radius"]
    parts = np.maximum(1, -(-sizes // block))
    number = F.array(*[F.lit(int(p)) for p in parts])[F.col("group")]
    vectors = assigned.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(7)), number).cast("int"))
    return VectorGroups(vectors, centres, radii, sizes, parts, centres.shape[1])


def _ordered(grouped: VectorGroups, queries: DataFrame) -> DataFrame:
    """(query_id, unit, groups, bounds): all groups of each query by their least possible angle, nearest first."""
    held = queries.sparkSession.sparkContext.broadcast((grouped.centres, grouped.radii))

    def run(batches):
        centres, radii = held.value
        for batch in batches:
            if batch.num_rows:
                unit = _directions(batch.column("vec").to_pylist())
                bound = np.maximum(np.arccos(np.clip(unit @ centres.T, -1, 1)) - radii, 0)
                order = np.argsort(bound, axis=1, kind="stable")
                columns = [pa.array(list(unit), pa.list_(pa.float64())), pa.array(list(order), pa.list_(pa.int32())), pa.array(list(np.take_along_axis(bound, order, 1)), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), *columns], ["query_id", "unit", "groups", "bounds"])

    kind = dict(queries.dtypes)["query_id"]
    return queries.select("query_id", "vec").mapInArrow(run, f"query_id {kind}, unit array<double>, groups array<int>, bounds array<double>")


def _visit(grouped: VectorGroups, pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of each visited part for the (query_id, unit, group, least) that visit it;
    vectors whose angle to the centre rules out the score ``least`` are not compared."""
    parts = F.array(*[F.lit(int(p)) for p in grouped.parts])[F.col("group")]
    asked = pairs.withColumns({"part": F.explode(F.sequence(F.lit(0), parts - 1)), "slice": F.pmod(F.xxhash64("query_id"), F.lit(1 << 30))})
    slices = np.zeros(len(grouped.centres), int)
    for r in pairs.groupBy("group").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("slices")).collect():  # a row per group
        slices[r["group"]] = r["slices"]
    slices = F.array(*[F.lit(int(s)) for s in slices])[F.col("group")]
    asked = asked.withColumn("slice", (F.col("slice") % slices).cast("int"))
    offered = grouped.vectors.where(slices > 0).withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    kinds = f"query_id {dict(pairs.dtypes)['query_id']}, vec_id {dict(grouped.vectors.dtypes)['vec_id']}, score double"
    centres = pairs.sparkSession.sparkContext.broadcast(grouped.centres)

    def match(key, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        v = v.sort_values("angle")
        unit, angle, ids = np.stack(v["unit"].to_numpy()), v["angle"].to_numpy(), v["vec_id"].to_numpy()
        asked = np.stack(q["unit"].to_numpy())
        away = np.arccos(np.clip(asked @ centres.value[key[0]], -1, 1))
        reach = np.arccos(np.clip(q["least"].to_numpy(), -1, 1)) + MARGIN
        # Queries go in order of their angle to the centre, so the angles that a run of them can reach lie together.
        order, found = np.argsort(away, kind="stable"), []
        for start in range(0, len(order), 64):
            run = order[start : start + 64]
            a = np.searchsorted(angle, (away[run] - reach[run]).min(), side="left")
            b = np.searchsorted(angle, (away[run] + reach[run]).max(), side="right")
            if a < b:
                scores, at = _best(asked[run] @ unit[a:b].T, ids[a:b], k)
                found.append(pd.DataFrame({"query_id": np.repeat(q["query_id"].to_numpy()[run], at.shape[1]), "vec_id": at.ravel(), "score": scores.ravel()}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    key = ["group", "part", "slice"]
    return asked.groupBy(*key).cogroup(offered.groupBy(*key)).applyInPandas(match, kinds)


def top_k(grouped: VectorGroups, queries: DataFrame, k: int = 5, report: list | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest vectors of each query (query_id, vec), as ``dense.top_k`` gives them.

    Null queries are left out; ties go to the smaller id. In each round a query visits as many groups as in all rounds
    before, as long as their bound can still beat its k-th best score; if bounds rule out less than half of a round, the
    rest is one round. ``report`` receives (visited, all) pairs of query and group.
    """
    order = [F.desc(F.round("score", 9)), "vec_id"]
    queries = queries.where("vec IS NOT NULL")
    if not len(grouped.centres) or queries.isEmpty():
        return top_per_group(queries.select("query_id").join(grouped.vectors.where("false").select("vec_id", F.col("angle").alias("score"))), "query_id", order, k)
    ordered = materialize(_ordered(grouped, queries), "ordered")
    asked = ordered.count()
    best, start, step, visited = None, 0, max(1, int(np.searchsorted(np.cumsum(np.sort(grouped.sizes)[::-1]), k)) + 1), 0
    while start < len(grouped.centres):
        now = ordered if best is None else ordered.join(_least(best, k), "query_id", "left")
        least = F.lit(-1.0) if best is None else F.coalesce("least", F.lit(-1.0))
        window = F.arrays_zip(F.slice("groups", start + 1, step).alias("group"), F.slice("bounds", start + 1, step).alias("bound"))
        pairs = now.select("query_id", "unit", least.alias("least"), F.inline(window)).where(F.cos("bound") >= F.col("least") - MARGIN)
        pairs = materialize(pairs.select("query_id", "unit", "least", "group"), "visits")
        n = pairs.count()
        visited += n
        if not n:
            break  # bounds go up, so later groups cannot beat the best either
        found = _visit(grouped, pairs, k)
        found = found if best is None else found.unionByName(best.select("query_id", "vec_id", "score"))
        best = materialize(top_per_group(found, "query_id", order, k), "nearest")
        ruled_out = 1 - n / (asked * min(step, len(grouped.centres) - start))
        start += step
        step = len(grouped.centres) if start > step and ruled_out < 0.5 else start
    if report is not None:
        report.append((visited, asked * len(grouped.centres)))
    return best


def _least(best: DataFrame, k: int) -> DataFrame:
    """(query_id, least): the k-th best score so far."""
    return best.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
