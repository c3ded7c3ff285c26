"""Removal of long repeated byte strings, with a sparse Burrows-Wheeler merge.

A string of ``length`` bytes is repeated if it starts at two places, in one document or in two. Only the suffixes at
anchors are ordered: the anchor of a window of ``length`` bytes is the place of its smallest k-gram hash, so equal
windows have their anchor at the same offset, and the windows of one anchor are consecutive. The windows of an anchor
form one segment of a document.

Segments that are equal as a whole are settled by counting hashes. Where an anchor has unlike segments, one of each
kind is kept as a suffix, all suffixes of the anchor are interleaved, and the interleave is refined:

* by one more byte to the right per round, which is the merge of the shards' lists by iterative interleave refinement:
  suffixes that are alone in their interval drop out, and the round at which neighbours part is their common prefix;
* then by one more byte to the left per round, in the order of the Burrows-Wheeler symbol before each suffix (a stable
  distribution, no suffix is compared again). The common prefix of new neighbours is the minimum over the interval
  between them, plus the step, and intervals whose common prefix reaches ``length`` are the repeated windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from churnspark.llm.common import arrow_rows, row_of
from churnspark.operators.sizing import fits
from churnspark.session import materialize

LENGTH = 400
#: Bytes of the k-gram of an anchor, a power of two.
GRAM = 128
#: Kinds of segments of one anchor that are interleaved in one task; beyond that, windows are counted by their hashes.
MAX_GROUP = 20_000
#: Suffixes that are interleaved at a time; whole anchors are added until there are as many.
BATCH = 16_384
#: Most rows and bytes of ranges or kinds that are sent to the documents; beyond either, documents are shuffled to them.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 48 * 1024 * 1024
_PLACE = np.uint64((1 << 28) - 1)
#: Windows of a text that are read at a time.
BLOCK = 1 << 23


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position on, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    factor, size = 0x100000001B3, 1
    while size < k:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor, size = factor * factor % 2**64, 2 * size
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sliding_min(values: np.ndarray, window: int) -> np.ndarray:
    n, size = len(values) - window + 1, 1
    while 2 * size <= window:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[window - size : window - size + n]) if size < window else values[:n]


def anchors(data: bytes, length: int = LENGTH, k: int = GRAM, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window, place) of every anchor; windows are named by their first byte. A text is read
    ``block`` windows at a time, so places in a block fit the bits that they have."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.view(np.uint64), none, none, none
    found = []
    windows = len(data) - length + 1
    for start in range(0, windows, block):
        h = _gram_hashes(np.frombuffer(data, np.uint8, min(block, windows - start) + length - 1, start), k)
        # Smallest upper bits, the rightmost place among equals: both follow from the window's bytes alone.
        best = _sliding_min((h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64)), length - k + 1)
        place = (_PLACE - (best & _PLACE)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(place))
        first, last = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(place) - 1]])
        at = place[first]
        found.append((h[at], first + start, last + start, at + start))
    h, first, last, at = (np.concatenate(c) for c in zip(*found))
    # Windows on both sides of a cut between blocks may share their anchor.
    fresh = np.flatnonzero(np.diff(at, prepend=-1))
    return h[fresh], first[fresh], last[np.append(fresh[1:], len(at)) - 1], at[fresh]


def _refine(group: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of all suffixes, refined byte by byte, and the common prefix with the one before (-1: other group)."""
    n, length = right.shape
    first = np.concatenate([[True], group[1:] != group[:-1]])[:n]
    order, cls = np.arange(n), np.maximum.accumulate(np.where(first, np.arange(n), 0))  # an interval by its first rank
    prefix = np.where(first, -1, length)
    for t in range(length):
        same = np.concatenate([[False], cls[1:] == cls[:-1], [False]])
        active = np.flatnonzero(same[:-1] | same[1:])  # in an interval of more than one suffix
        if not len(active):
            break
        who = order[active]
        symbol = np.where(sizes[who] > t, right[who, t].astype(np.int64), 256)
        key = cls[active] * 257 + symbol
        moved = np.argsort(key, kind="stable")
        order[active], key, symbol = who[moved], key[moved], symbol[moved]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (symbol[1:] == 256)])
        # Neighbours that part now have t bytes in common, unless they were apart before.
        before = cls[active]
        parted = active[1:][new[1:] & (before[1:] == before[:-1])]
        prefix[parted] = t
        cls[active] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
    return order, prefix


def repeated_windows(group: np.ndarray, texts: list[bytes], offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the least and the largest distance from a repeated window's start to the anchor (-1: none).

    ``group`` is ascending; ``texts`` are segments and ``offsets`` the places of the anchor in them. All windows of a
    segment hold its anchor, so the repeated ones together cover one run of bytes.
    """
    n = len(texts)
    sizes = np.array([min(len(s) - o, length) for s, o in zip(texts, offsets.tolist())], np.int64)
    widest = int(offsets.max(initial=0))
    right, left = np.zeros((n, length), np.uint8), np.zeros((n, max(widest, 1)), np.uint8)
    for i, (s, o) in enumerate(zip(texts, offsets.tolist())):
        raw = np.frombuffer(s, np.uint8)
        right[i, : sizes[i]] = raw[o : o + length]
        left[i, :o] = raw[:o][::-1]
    order, prefix = _refine(group, right, sizes)
    least, largest = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    for x in range(widest + 1):
        long = np.flatnonzero(prefix >= length - x)
        if len(long):
            who = np.unique(np.concatenate([order[long], order[long - 1]]))
            largest[who] = x
            least[who] = np.where(least[who] < 0, x, least[who])
        if x == widest:
            break
        # One step to the left: a stable distribution of the interleave by the symbol before each suffix.
        block = np.cumsum(prefix < 0)
        kept = np.flatnonzero(offsets[order] > x)
        key = block[kept] * 256 + left[order[kept], x]
        moved = np.argsort(key, kind="stable")
        at, key = kept[moved], key[moved]
        fresh = np.full(len(at), -1)
        joined = np.flatnonzero(key[1:] == key[:-1]) + 1
        if not len(joined):
            break
        ranges = np.stack([at[joined - 1] + 1, at[joined] + 1], axis=1).ravel()
        fresh[joined] = np.minimum.reduceat(np.append(prefix, -1), ranges)[::2]
        held = fresh >= 0
        company = held | np.append(held[1:], False)  # suffixes alone in their interval drop out
        order, prefix = order[at[company]], fresh[company]
    return least, largest


def _segments(docs: DataFrame, length: int, k: int) -> DataFrame:
    schema = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("place", pa.int64())])
    digest = xxhash.xxh3_64_intdigest

    if length > 0xFFFF:
        raise ValueError("distances from a window to its anchor are held in 16 bits")

    def run(batches):
        for batch in batches:
            parts, ids, keys, segs = [], [], [], []
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = text.as_py().encode()
                h, u, v, p = anchors(data, length, k)
                if len(h):
                    parts.append((h, u, v, p))
                    ids += [doc] * len(h)
                    keys += [key] * len(h)
                    view = memoryview(data)
                    segs += [digest(view[a:b]) for a, b in zip(u.tolist(), (v + length).tolist())]
            if parts:
                h, u, v, p = (np.concatenate(c) for c in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(np.array(segs, np.uint64).view(np.int64)), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()),
                     pa.array((u << 32) | ((p - u) << 16) | (v - u))], schema=schema
                )

    return docs.mapInArrow(run, "anchor bigint, seg bigint, doc_id bigint, text_key bigint, place bigint")


def _unpacked() -> tuple:
    """First window, distance from it to the anchor, and distance to the last window, from the column ``place``."""
    place = F.col("place")
    return F.shiftright(place, 32).cast("int"), F.shiftright(place, 16).bitwiseAND(F.lit(0xFFFF)).cast("int"), place.bitwiseAND(F.lit(0xFFFF)).cast("int")


def _with(docs: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """Documents joined with a written table on id and text; no text is shuffled if the table is measured small."""
    same = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d.text_key") == F.col("t.text_key"))
    table = F.broadcast(table) if fits(table, BROADCAST_ROWS, BROADCAST_BYTES) else table
    joined = docs.alias("d").join(table.alias("t"), same, how)
    return joined.select("d.*", *[F.col(f"t.{c}") for c in table.columns if c not in ("doc_id", "text_key")])


def _interleaved(kinds: DataFrame, length: int, batch_rows: int) -> DataFrame:
    """(anchor, seg, least, largest) of the kinds (anchor, seg, o, bytes) that have a repeated window."""
    schema = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("least", pa.int32()), ("largest", pa.int32())])

    def rows(batches):
        anchor, seg, offset, texts = [], [], [], []

        def settle(n):
            keys = np.array(anchor[:n], np.int64)
            least, largest = repeated_windows(np.cumsum(np.diff(keys, prepend=keys[0]) != 0), texts[:n], np.array(offset[:n], np.int64), length)
            for i in np.flatnonzero(least >= 0).tolist():
                yield anchor[i], seg[i], int(least[i]), int(largest[i])
            for held in (anchor, seg, offset, texts):
                del held[:n]

        for batch in batches:
            for i, kind in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if anchor and kind == (anchor[-1], seg[-1]):
                    continue  # a kind comes again from other tasks
                anchor.append(kind[0])
                seg.append(kind[1])
                offset.append(batch.column(2)[i].as_py())
                texts.append(batch.column(3)[i].as_py())
            if len(anchor) >= batch_rows:
                n = anchor.index(anchor[-1])  # the last anchor may go on in the next batch
                if n:
                    yield from settle(n)
        if anchor:
            yield from settle(len(anchor))

    return kinds.mapInArrow(arrow_rows(schema, rows), "anchor bigint, seg bigint, least int, largest int")


def _once_a_task(kinds: DataFrame) -> DataFrame:
    """Without the rows whose kind (anchor, seg) the same task has passed on before: repeats of a whole row have it."""

    def run(batches):
        seen = set()
        for batch in batches:
            fresh = [i for i, kind in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())) if kind not in seen and not seen.add(kind)]
            yield batch if len(fresh) == batch.num_rows else batch.take(pa.array(fresh, pa.int64()))

    return kinds.mapInArrow(run, kinds.schema)


def _counted(kinds: DataFrame, length: int, k: int) -> DataFrame:
    """The same by counting the hashes of all windows of the kinds: for anchors with too many kinds for one task."""
    schema = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("x", pa.int32()), ("h", pa.int64())])

    def rows(batches):
        for batch in batches:
            for anchor, seg, o, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                view = memoryview(data)
                for a in range(len(data) - length + 1):
                    yield anchor, seg, o - a, xxhash.xxh3_64_intdigest(view[a : a + length]) - 2**63

    windows = kinds.mapInArrow(arrow_rows(schema, rows, 16384), "anchor bigint, seg bigint, x int, h bigint")
    # Kinds, not rows: a kind may come from several tasks.
    again = windows.groupBy("anchor", "x", "h").agg(F.min("seg").alias("low"), F.max("seg").alias("high")).where("low <> high").select("anchor", "x", "h")
    return windows.join(again, ["anchor", "x", "h"]).groupBy("anchor", "seg").agg(F.min("x").alias("least"), F.max("x").alias("largest"))


def repeats(docs: DataFrame, length: int = LENGTH, k: int = GRAM, max_group: int = MAX_GROUP, batch_rows: int = BATCH) -> DataFrame:
    """(doc_id, text_key, spans): byte ranges covered by repeated strings, per class of rows with equal id and text.

    ``docs`` has doc_id, text_key, text. Ranges of a document may overlap. An anchor that a third of all rows share is
    counted with partial aggregates; only one segment of each kind is ever compared.
    """
    first, to_anchor, to_last = _unpacked()
    rows = materialize(_segments(docs, length, k), "segments")
    # What rows are joined with is written first: between two plain exchanges Spark can split a hot anchor.
    several = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("seg").alias("low"), F.max("seg").alias("high")).where("n > 1")
    several = materialize(several.select("anchor", (F.col("low") != F.col("high")).alias("unlike")), "several")
    shared = materialize(rows.join(several, "anchor"), "shared")
    counts = shared.groupBy("anchor", "seg", "unlike").agg(F.count("*").alias("n"))
    one = materialize(shared.where("unlike").dropDuplicates(["anchor", "seg"]).select("anchor", "seg", "doc_id", "text_key", first.alias("u"), to_anchor.alias("o"), to_last.alias("w")), "kinds")
    cut = F.substring(F.col("text").cast("binary"), F.col("u") + 1, F.col("w") + length)
    kinds = _once_a_task(_with(docs, one, "inner").select("anchor", "seg", "o", cut.alias("bytes")))
    sizes = one.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > max_group).select("anchor")
    large = materialize(sizes, "large")
    usual = kinds.join(large, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor", "seg")
    partial = _interleaved(usual, length, batch_rows)
    if not large.isEmpty():
        partial = partial.unionByName(_counted(kinds.join(large, "anchor", "left_semi"), length, k))
    cover = counts.select("anchor", "seg", "n").join(partial, ["anchor", "seg"], "left").where("n > 1 or least is not null")
    cover = materialize(cover, "cover")
    spans = shared.drop("unlike").join(cover, ["anchor", "seg"]).select(
        "doc_id",
        "text_key",
        F.struct(
            F.when(F.col("n") > 1, first).otherwise(first + to_anchor - F.col("largest")).alias("a"),
            (F.when(F.col("n") > 1, first + to_last).otherwise(first + to_anchor - F.col("least")) + length).alias("b"),
        ).alias("span"),
    )
    # Rows that repeat with id and text have the same ranges.
    return spans.distinct().groupBy("doc_id", "text_key").agg(F.collect_list("span").alias("spans"))


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = GRAM, max_group: int = MAX_GROUP, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text; the columns in ``extra`` come
    along as one struct ``row``.

    Every byte covered by a ``length``-byte string that also starts elsewhere is removed, in all its places. A null text
    is empty; texts shorter than ``length`` keep everything; repeated rows are documents of their own, so each is a
    repeat of the other. ``kept_sha256`` is of the remaining bytes; ``kept_text`` drops bytes of cut characters. An
    empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    carried = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(extra)]
    docs = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"), *carried)
    spans = materialize(repeats(docs.select("doc_id", "text_key", "text"), length, k, max_group), "spans")
    joined = _with(docs, spans, "left").select("doc_id", "text", "spans", *[f"_{i}" for i in range(len(extra))])
    kinds = dict(df.dtypes)
    columns = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string" + "".join(f", _{i} {kinds[c]}" for i, c in enumerate(extra))

    def run(batches):
        for batch in batches:
            size, removed, count, sha, kept = [], [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                data, cut = text.as_py().encode(), _merged(spans.as_py())
                rest = b"".join(data[a:b] for a, b in zip([0, *(b for _, b in cut)], [*(a for a, _ in cut), len(data)]))
                size.append(len(data))
                removed.append(len(data) - len(rest))
                count.append(len(cut))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode(errors="ignore"))
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in (size, removed, count)), pa.array(sha, pa.string()), pa.array(kept, pa.string()), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", *batch.schema.names[3:]])

    out = joined.mapInArrow(run, columns)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", *row_of(extra))
