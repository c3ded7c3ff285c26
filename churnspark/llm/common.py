"""Helpers shared by the operators: words, Arrow maps, columns and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from churnspark.session import materialize

#: Bytes that belong to a word keep their (lower-case) value; all other ASCII bytes become a space.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z in lower case, as UTF-8; null has none."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text under fixed names (a null text is empty), so no other column of the caller can clash."""
    return df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added while ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_of(columns: tuple[str, ...]) -> list:
    """Columns that were carried as _0, _1, ... as one struct ``row`` under their own names; none for no columns."""
    return [F.struct(*[F.col(f"_{i}").alias(c) for i, c in enumerate(columns)]).alias("row")] if columns else []


def arrow_rows(schema: pa.Schema, rows: Callable[[Iterator[pa.RecordBatch]], Iterable[tuple]], size: int = 4096):
    """Turn a function from batches to row tuples into a mapInArrow function with bounded output batches."""

    def run(batches):
        pending: list[tuple] = []
        for row in rows(batches):
            pending.append(row)
            if len(pending) >= size:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pending), schema)], schema=schema)
                pending = []
        if pending:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pending), schema)], schema=schema)

    return run


def _signature(edges: DataFrame):
    return edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars: (node, component), component = smallest node.

    ``edges`` has two columns of one orderable type; direction, repeats, loops and rows with a null end do not
    matter (a node that has only loops is not returned). Each round is a pair of partial aggregations and joins
    and is written to the shared folder, so a hub of any degree is never gathered in one task and a lost executor
    costs no recomputation of earlier rounds. An empty edge table gives an empty result.
    """
    u, v = edges.columns
    plain = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct()
    current = materialize(plain, "edges")
    before = _signature(current)
    while before[0]:
        current = materialize(_small_star(_large_star(current)), "edges")
        after = _signature(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
