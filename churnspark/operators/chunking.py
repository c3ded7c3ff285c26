"""Chunks of texts: fixed stride (expressions only) and by separators (Arrow batches)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Chunk sizes and overlaps in characters, and the separators in order of preference.
INGEST = (500, 50)
PARENT = (2000, 200)
CHILD = (400, 50)
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
#: Characters of chunks in one output batch.
BATCH_CHARS = 4 * 1024 * 1024


def _fixed_pieces(text: Column, size: int, overlap: int) -> Column:
    """Array of (no, start, text): every piece but the last is ``size`` long, each starts ``size - overlap`` later."""
    stride = size - overlap
    length = F.length(text)
    last = F.greatest(F.ceil((length - overlap) / stride), F.lit(1)).cast("int") - 1
    numbers = F.when(length > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        numbers,
        lambda i: F.struct(
            i.cast("bigint").alias("no"),
            (i * stride).cast("bigint").alias("start"),
            F.substring(text, i * stride + 1, F.lit(size)).alias("text"),
        ),
    )


def fixed(documents: DataFrame, keys: list[str], text: str, size: int, overlap: int, no: str = "chunk_no") -> DataFrame:
    """Fixed-stride chunks. The pieces are cut before the explode, so rows never carry the whole text."""
    pieces = documents.select(*keys, F.inline(_fixed_pieces(F.col(text), size, overlap)))
    return pieces.select(*keys, F.col("no").alias(no), "start", F.col("text"))


def split_spans(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """(start, end) of each chunk: pieces between separators, merged up to ``size``.

    A piece keeps the separator that ends it. A piece longer than ``size`` is cut by the next
    separators. The next chunk repeats trailing whole pieces of at most ``overlap`` characters.
    """

    def pieces(start: int, end: int, rest: tuple[str, ...]) -> Iterator[tuple[int, int]]:
        if end - start <= size:
            yield start, end
            return
        at = next((i for i, s in enumerate(rest) if s == "" or text.find(s, start, end) >= 0), None)
        separator = "" if at is None else rest[at]
        if separator == "":
            for cut in range(start, end, size):
                yield cut, min(cut + size, end)
            return
        while start < end:
            found = text.find(separator, start, end)
            stop = end if found < 0 else found + len(separator)
            yield from pieces(start, stop, rest[at + 1 :])
            start = stop

    chunks: list[tuple[int, int]] = []
    held: list[tuple[int, int]] = []
    for piece in pieces(0, len(text), separators):
        if held and piece[1] - held[0][0] > size:
            chunks.append((held[0][0], held[-1][1]))
            while held and (held[-1][1] - held[0][0] > overlap or piece[1] - held[0][0] > size):
                held.pop(0)
        held.append(piece)
    if held and held[-1][1] > held[0][0]:
        chunks.append((held[0][0], held[-1][1]))
    return chunks


def by_separators(
    documents: DataFrame, keys: list[str], text: str, size: int, overlap: int, no: str = "chunk_no"
) -> DataFrame:
    """Chunks along the hierarchy of separators, in Arrow batches."""
    schema = T.StructType(
        [documents.schema[k] for k in keys]
        + [
            T.StructField(no, T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("text", T.StringType()),
        ]
    )

    types = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, starts, texts = [], [], [], []
            made = 0

            def full():
                taken = batch.select(keys).take(pa.array(rows, pa.int64()))
                parts = ((no, numbers), ("start", starts), ("text", texts))
                arrays = [pa.array(v, type=types.field(n).type) for n, v in parts]
                return pa.RecordBatch.from_arrays([*taken.columns, *arrays], schema=types)

            for row, cell in enumerate(batch.column(text)):
                body = cell.as_py()
                for i, (a, b) in enumerate(split_spans(body, size, overlap) if body else []):
                    rows.append(row)
                    numbers.append(i)
                    starts.append(a)
                    texts.append(body[a:b])
                    made += b - a
                    if made > BATCH_CHARS:
                        yield full()
                        rows, numbers, starts, texts, made = [], [], [], [], 0
            yield full()

    return documents.select(*keys, text).mapInArrow(cut, schema)


def two_tier(documents: DataFrame, keys: list[str], text: str, cutter=fixed, parent=PARENT, child=CHILD) -> DataFrame:
    """Child chunks with the number of the parent chunk they are cut from."""
    parents = cutter(documents, keys, text, *parent, "parent_no")
    children = cutter(parents.drop("start"), [*keys, "parent_no"], "text", *child, "child_no")
    return children.drop("start")


def parents(documents: DataFrame, keys: list[str], text: str, cutter=fixed, parent=PARENT) -> DataFrame:
    return cutter(documents, keys, text, *parent, "parent_no").drop("start")
