"""Broadcast only what has been measured to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

#: A side above either bound is left to a shuffle join.
MAX_ROWS = 200_000
MAX_BYTES = 64 * 1024 * 1024


def _width(field: T.StructField):
    """Approximate bytes of one value of a column."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(field.dataType, T.ArrayType):
        return F.greatest(F.size(c), F.lit(0)) * 8
    return F.lit(8)


def fits(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """Measure ``df`` by partial sums, which no task gathers rows for. Pass a table or a short plan over one."""
    row_bytes = sum((_width(f) for f in df.schema.fields), F.lit(0))
    seen = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row_bytes.cast("bigint")), F.lit(0)).alias("bytes")).first()
    return seen["n"] <= max_rows and seen["bytes"] <= max_bytes
