"""Exact cosine top-k over vectors.

The query vectors are multiplied against Arrow batches of the corpus inside tasks, and a
task emits only its best ``k`` rows per query. No query/vector pair is ever a Spark row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from churnspark.operators.ranking import top_per_group
from churnspark.operators.sizing import fits

#: A query table above either bound is matched block by block instead of being sent to every task.
MAX_QUERIES = 4096
MAX_QUERY_BYTES = 32 * 1024 * 1024
BLOCK_VECTORS = 4096  # a block of scores is at most MAX_QUERIES x BLOCK_VECTORS doubles, 128 MB


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (queries x <=k) of the highest scores to nine decimals, ties to the smaller id.

    ``ids`` is one row of ids for all queries, or one row per query.
    """
    scores = np.round(scores, 9)
    ids = np.broadcast_to(ids, scores.shape)
    n = scores.shape[1]
    if n > k:
        # More than k may tie at the cut; all of them are looked at.
        cut = np.partition(scores, n - k, axis=1)[:, n - k, None]
        near = scores >= cut
        width = int(near.sum(axis=1).max())
        at = np.argsort(~near, axis=1, kind="stable")[:, :width]
        kept = np.take_along_axis(near, at, axis=1)
        scores, ids = np.where(kept, np.take_along_axis(scores, at, axis=1), -np.inf), np.take_along_axis(ids, at, axis=1)
    order = np.argsort(ids, axis=1, kind="stable")
    scores, ids = np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)


def _block_top(query_ids, queries, ids, vectors, k) -> pd.DataFrame:
    scores, found = _best(_unit(queries) @ _unit(vectors).T, ids, k)
    return pd.DataFrame({"query_id": np.repeat(query_ids, found.shape[1]), "vec_id": found.ravel(), "score": scores.ravel()})


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def top_k(corpus: DataFrame, queries: DataFrame, k: int = 5, force_blocks: bool = False) -> DataFrame:
    """(query_id, vec_id, score, rank): for each query the ``k`` nearest vectors by cosine.

    ``corpus`` has vec_id and vec, ``queries`` has query_id and vec. Filters on the corpus
    belong before this call, where Spark pushes them into the scan.
    """
    out = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("vec_id", corpus.schema["vec_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    corpus = corpus.select("vec_id", "vec").filter("vec IS NOT NULL")
    queries = queries.select("query_id", "vec").filter("vec IS NOT NULL")
    if not force_blocks and fits(queries, MAX_QUERIES, MAX_QUERY_BYTES):
        local = _with_broadcast(corpus, queries, k, out)
    else:
        local = _by_blocks(corpus, queries, k, out)
    return top_per_group(local, "query_id", [F.desc(F.round("score", 9)), "vec_id"], k)


def _with_broadcast(corpus: DataFrame, queries: DataFrame, k: int, out: T.StructType) -> DataFrame:
    """Every task holds the measured, bounded query matrix and keeps a running best."""
    rows = queries.collect()
    if not rows:
        return corpus.sparkSession.createDataFrame([], out)
    ids = [r["query_id"] for r in rows]
    matrix = _unit(np.array([r["vec"] for r in rows], dtype=np.float64))
    shared = corpus.sparkSession.sparkContext.broadcast((ids, matrix))
    schema = to_arrow_schema(out)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, unit_queries = shared.value
        best = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vec_ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            vectors = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            scores = unit_queries @ _unit(vectors.reshape(batch.num_rows, -1)).T
            found = _best(scores, vec_ids, k)
            if best is not None:
                found = _best(*(np.concatenate(c, axis=1) for c in zip(best, found)), k)
            best = found
        if best is not None:
            columns = ([q for q in query_ids for _ in range(best[1].shape[1])], best[1].ravel(), best[0].ravel())
            arrays = [pa.array(c, type=f.type) for c, f in zip(columns, schema)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return corpus.mapInArrow(search, out)


def _by_blocks(corpus: DataFrame, queries: DataFrame, k: int, out: T.StructType) -> DataFrame:
    """Bounded blocks of queries meet bounded blocks of vectors in cogrouped tasks."""
    query_blocks = max(1, math.ceil(queries.count() / MAX_QUERIES))
    corpus_blocks = max(1, math.ceil(corpus.count() / BLOCK_VECTORS))

    def own(df, c, blocks, name):
        return df.withColumn(name, F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int"))

    def every(df, blocks, name):
        return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    # Both sides may derive from one table, so the query side gets columns of its own.
    queries = queries.select(F.col("query_id").alias("query_id"), F.col("vec").alias("query_vec"))
    left = every(own(queries, "query_id", query_blocks, "qb"), corpus_blocks, "cb").groupBy("qb", "cb")
    right = every(own(corpus, "vec_id", corpus_blocks, "cb"), query_blocks, "qb").groupBy("qb", "cb")

    def match(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return pd.DataFrame({n: [] for n in out.names})
        return _block_top(q["query_id"].tolist(), _matrix(q["query_vec"]), v["vec_id"].to_numpy(), _matrix(v["vec"]), k)

    return left.cogroup(right).applyInPandas(match, out)


def centroids(vectors: DataFrame, label: str, vec: str, vec_id: str | None = None) -> DataFrame:
    """Mean vector per label, one dimension at a time so that the means are partial aggregates."""
    flat = vectors.select(F.col(label).alias("query_id"), F.posexplode(vec).alias("dim", "x"))
    means = flat.groupBy("query_id", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return means.groupBy("query_id").agg(F.transform(ordered, lambda e: e["x"]).alias("vec"))
