"""Bounded-space online best-fit packing of tokenised documents.

A fixed number of bins is open at a time. Their free spaces are the set bits of one bitset, so the tightest bin that
takes a piece is the lowest set bit at or above its length. When a bin more than allowed would be open, the fullest
closes first.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from churnspark.llm.common import arrow_rows, documents_of
from churnspark.session import materialize

CAPACITY = 2048
OPEN_BINS = 4096
#: Mean pieces of one batch, which arrive longest first, and mean batches of one packer; each packer is one task.
PIECES_PER_BATCH, BATCHES_PER_PACKER = 8192, 4
VOCABULARY, SPECIAL, SPECIAL_ID = "byte_bpe_50k", "<|endoftext|>", 50256


def encoder(name: str = VOCABULARY):
    """The byte-level BPE of ``<name>.json``, read from the same vocabulary's rank file; special strings are one id.

    The rank file's library cannot match runs of about a million white spaces; such a text is encoded by ``tokenizers``."""
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    made = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
    slow = []

    def encode(text: str) -> list[int]:
        try:
            return made.encode(text, allowed_special="all")
        except ValueError:
            if not slow:
                slow.append(Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))
            return slow[0].encode(text, add_special_tokens=False).ids

    return encode


class BestFit:
    """Online packer: ``place`` returns (bin number, offset) of a piece of 1 to ``capacity`` tokens."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, open_bins
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
        self.bits = 0
        self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            number, space = self.made, self.capacity
            self.made += 1
            if length < self.capacity and self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        if space > length:
            left = space - length
            self.free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - space

    def _take(self, space: int) -> int:
        number = self.free[space].pop()
        if not self.free[space]:
            self.bits &= ~(1 << space)
        self.open -= 1
        return number


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """(doc_id, text_key, piece, start, length, ids_crc32[, ids]): documents as token ids with a closing 0, cut only if
    longer than the capacity. The first piece of a cut document is the short one."""
    docs = documents_of(df, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
        + [("ids", pa.list_(pa.int32()))] * with_ids
    )

    def rows(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = np.array([*encode(text.as_py()), 0], "<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    yield (doc, key, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), *([ids[a:b].astype("i4")] * with_ids))

    columns = "doc_id bigint, text_key bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.mapInArrow(arrow_rows(schema, rows, 512 if with_ids else 8192), columns)


def pack(cut: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_batch: int = PIECES_PER_BATCH) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces (at least doc_id, text_key, piece, length).

    Pieces are dealt by a hash to batches and batches to packers. A packer is one task that streams its batches, the
    long pieces of a batch first, through one BestFit, and holds only its open bins. The number of packers follows
    the number of pieces. Sequence numbers are unique, not dense.
    """
    batches = max(1, round(cut.count() / per_batch))
    packers = -(-batches // BATCHES_PER_PACKER)
    draw = F.xxhash64("doc_id", "text_key", "piece")
    batch = F.pmod(draw, F.lit(batches)).cast("int")
    dealt = cut.withColumns({"batch": batch, "packer": F.pmod(batch, F.lit(packers))})
    names = cut.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    length_at = names.index("length")

    def run(batches):
        now, bins = None, None
        for batch in batches:
            sequence, offset = [], []
            for packer, length in zip(batch.column(len(names)).to_pylist(), batch.column(length_at).to_pylist()):
                if packer != now:
                    now, bins = packer, BestFit(capacity, open_bins)
                number, at = bins.place(length)
                sequence.append((packer << 40) + number)
                offset.append(at)
            arrays = [*batch.columns[: len(names)], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset"])

    parts = dealt.repartitionByRange(packers, "packer") if packers > 1 else dealt.repartition(1)
    order = ["packer", "batch", F.desc("length"), draw, "doc_id", "piece"]
    return parts.sortWithinPartitions(*order).select(*names, "packer").mapInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, vocabulary: str = VOCABULARY, per_batch: int = PIECES_PER_BATCH) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the single id 0. Repeated rows and null ids are packed like any other row. An empty table
    gives no rows. Token ids stay out of the shuffle; ``sequences`` builds them.
    """
    cut = materialize(pieces(df, id_col, text_col, capacity, vocabulary), "pieces")
    return pack(cut, capacity, open_bins, per_batch).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, each at most ``capacity`` ids."""
    cut = materialize(pieces(df, id_col, text_col, capacity, vocabulary, True), "pieces")
    parts = pack(cut, capacity, open_bins).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
