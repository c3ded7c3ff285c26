"""Benchmark decontamination by winnowing.

Of every window of consecutive k-gram hashes the smallest is kept, for texts and items alike; a span of ``span`` words
that a document shares with an item holds a whole window, so both sides keep the same k-gram of it. The kept hashes of
both sides meet in a join; a document's hits are then extended to the spans around the k-gram, which are joined again,
as a whole, and united. Items shorter than ``span`` are one span of their own length and are their own fingerprint.

Documents stay where they are read: only fingerprints leave a task, and those that the benchmark lacks go no further if
its fingerprints are measured small enough to be broadcast. Nothing of the benchmark passes through the driver but the
lengths of its short items, of which there are fewer than ``span``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from churnspark.llm.common import documents_of, free_name, words
from churnspark.operators import sizing
from churnspark.session import materialize

SPAN, GRAM = 10, 5
#: Words that are fingerprinted together; longer texts are taken in blocks that overlap by a span.
BLOCK_WORDS = 1 << 17
#: Words whose hashes a task holds at a time.
_HELD_WORDS = 500_000
_PRINTS = "text_key bigint, gram bigint, at int, n int, spans array<bigint>"


class _WordHashes(dict):
    """64-bit hashes of words, each computed when it is first met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _HELD_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def _runs(ids: np.ndarray, n: int) -> np.ndarray:
    """Odd hash of every run of n words; runs of unlike length have unlike hashes."""
    m = max(len(ids) - n + 1, 0)
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + m]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(32))) | np.uint64(1)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Position of the rightmost smallest hash of every window of consecutive hashes."""
    n = max(len(hashes) - window + 1, 0)
    best, at = hashes[:n].copy(), np.arange(n)
    for i in range(1, window):
        better = hashes[i : i + n] <= best
        best = np.where(better, hashes[i : i + n], best)
        at[better] = np.flatnonzero(better) + i
    return at


def _block(pieces: list[tuple[int, int, np.ndarray]], span: int, gram: int, lengths: tuple[int, ...] | None):
    """Fingerprints of pieces (text key, first word, word hashes), which lie one after the other in one array."""
    ids = np.concatenate([p[2] for p in pieces])
    size = np.array([len(p[2]) for p in pieces])
    piece = np.repeat(np.arange(len(pieces)), size)
    key = np.array([p[0] for p in pieces], np.int64)
    shift = np.array([p[1] for p in pieces]) - (np.cumsum(size) - size)

    def batch(at, hashes, n, spans, counts):
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        columns = [
            pa.array(key[piece[at]]),
            pa.array(hashes.view(np.int64)),
            pa.array((at + shift[piece[at]]).astype(np.int32)),
            pa.array(np.full(len(at), n, np.int32)),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(spans.view(np.int64))),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["text_key", "gram", "at", "n", "spans"])

    whole = _runs(ids, span)
    if len(whole):
        inside = piece[: len(whole)] == piece[span - 1 :]
        grams = _runs(ids, gram)
        chosen = winnow(grams, span - gram + 1)
        kept = np.unique(chosen[inside])
        if len(kept):
            # spans[i, j]: the span that begins j words before the kept gram, if the gram is the one kept of it; else 0.
            start = kept[:, None] - np.arange(span - gram + 1)[None, :]
            at = np.clip(start, 0, len(whole) - 1)
            own = (start == at) & inside[at] & (chosen[at] == kept[:, None])
            yield batch(kept, grams[kept], span, np.where(own, whole[at], np.uint64(0)).ravel(), np.full(len(kept), span - gram + 1))
    for n in sorted(set(size[size < span].tolist())) if lengths is None else lengths:
        found = _runs(ids, n)
        inside = piece[: len(found)] == piece[n - 1 :] if len(found) else np.zeros(0, bool)
        if lengths is None:
            inside &= size[piece[: len(found)]] == n
        at = np.flatnonzero(inside)
        if len(at):
            yield batch(at, found[at], n, found[at], np.ones(len(at), np.int64))


def prints(texts: DataFrame, span: int = SPAN, gram: int = GRAM, lengths: tuple[int, ...] | None = None) -> DataFrame:
    """Kept k-grams of (text_key, text): gram (its hash), at (its word), n, and spans: hashes of the spans of n words whose
    kept gram it is, by how many words they begin before it (0: none).

    Besides, every run of each of ``lengths`` words is its own gram; without lengths, every text shorter than a span.
    """

    def run(batches):
        hashes, pieces, held = _WordHashes(), [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = hashes.of(words(text.as_py()))
                for a in range(0, max(len(ids) - span + 1, min(len(ids), 1)), BLOCK_WORDS):
                    pieces.append((key, a, ids[a : a + BLOCK_WORDS + span - 1]))
                    held += len(pieces[-1][2])
                    if held >= BLOCK_WORDS:
                        yield from _block(pieces, span, gram, lengths)
                        pieces, held = [], 0
        if pieces:
            yield from _block(pieces, span, gram, lengths)

    return texts.select("text_key", "text").mapInArrow(run, _PRINTS)


def _beside(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` as a side to broadcast if it is measured small, else as it is."""
    return F.broadcast(df) if sizing.fits(df, max_rows) else df


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("text_key", F.xxhash64("text"))


def _met(texts: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, span: int, gram: int, max_rows: int):
    """Spans of the texts that occur in the benchmark: (text_key, start, n, window), once for equal texts, as a written
    table; the spans of the benchmark: (window, item_key); and the ids of equal items: (item_key, item_id)."""
    gram = min(gram, span)
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    items = _keyed(items)
    known = materialize(prints(items.select("text_key", "text").distinct(), span, gram), "benchmark-prints")
    lengths = tuple(sorted(r["n"] for r in known.where(F.col("n") < span).select("n").distinct().collect()))
    windows = known.select(F.explode("spans").alias("window"), F.col("text_key").alias("item_key")).where("window <> 0").distinct()
    windows = materialize(windows, "benchmark-windows")
    found = prints(texts, span, gram, lengths).join(_beside(known.select("gram").distinct(), max_rows), "gram", "left_semi")
    spans = found.select("text_key", "at", "n", F.posexplode("spans").alias("before", "window")).where("window <> 0")
    spans = spans.join(_beside(windows.select("window").distinct(), max_rows), "window", "left_semi")
    met = spans.select("text_key", (F.col("at") - F.col("before")).alias("start"), "n", "window").distinct()
    members = items.where("item_id is not null").select(F.col("text_key").alias("item_key"), "item_id").distinct()
    return materialize(met, "benchmark-hits"), windows, members


def marked(df: DataFrame, benchmark: DataFrame, mark: str = "_contaminated", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, gram: int = GRAM, max_rows: int = sizing.MAX_ROWS) -> DataFrame:
    """The rows of ``df`` with a column ``mark``: whether a window of an item occurs in the text.

    Rows are shuffled only if the keys of the texts with hits are not measured small. A null text is false.
    """
    key = free_name(df, "text_key")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    met, _, _ = _met(_keyed(df.select(text.alias("text"))), benchmark, item_col, item_text_col, span, gram, max_rows)
    hit = met.select(F.col("text_key").alias(key), F.lit(True).alias(mark)).distinct()
    joined = df.withColumn(key, F.xxhash64(text)).join(_beside(hit, max_rows), key, "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(F.col(f"`{mark}`"), F.lit(False)).alias(mark))


def _word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_words) of every document."""

    def run(batches):
        for batch in batches:
            n = pa.array([len(words(t.as_py())) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=["doc_id", "text_key", "n_words"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id bigint, text_key bigint, n_words bigint")


def hits(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, gram: int = GRAM, max_rows: int = sizing.MAX_ROWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted ids of items with an occurring window), starts and ends of hits.

    Null texts and texts without a word have no hits; items without a word are never hit; items with a null id hit
    words but are not named. Equal items are one, with several ids; equal texts are one in all joins of fingerprints.
    Sides above ``max_rows`` rows are not broadcast. An empty table on either side is valid. Spans and texts are told
    apart by 64-bit hashes.
    """
    docs = _keyed(documents_of(df, id_col, text_col))
    met, windows, members = _met(docs, benchmark, item_col, item_text_col, span, gram, max_rows)
    # Runs of overlapping or touching spans within a text.
    order = Window.partitionBy("text_key").orderBy("start", "n")
    reach = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = met.select("text_key", "start", "n", (F.col("start") <= reach).alias("joins"))
    run = F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = placed.withColumn("run", run).groupBy("text_key", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"))
    ranges = runs.groupBy("text_key").agg(
        F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges")
    )
    of_item = met.select("text_key", "window").distinct().join(_beside(windows, max_rows), "window").select("text_key", "item_key").distinct()
    named = of_item.join(_beside(members, max_rows), "item_key").groupBy("text_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = materialize(
        ranges.join(named, "text_key", "left").select("text_key", "n_hit", "items", F.col("ranges.start").alias("starts"), F.col("ranges.end").alias("ends")), "benchmark-ranges"
    )
    joined = _word_counts(docs).join(_beside(found, max_rows), "text_key", "left")
    none = {"items": "array<string>", "starts": "array<int>", "ends": "array<int>"}
    empty = [F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in none.items()]
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), *empty)


def contaminated(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Digest of ``hits``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(df, benchmark, **options)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
