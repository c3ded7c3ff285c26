"""I-Match document fingerprints.

Terms whose document frequency lies in a band (a band of inverse document frequency) form the lexicon. A document
keeps its distinct lexicon terms in sorted order; they are hashed once as a whole and once per randomised lexicon
subset. Subsets are drawn at several rates, so that for a text of any length some subsets hold just a few of its
terms: only those can agree for texts that share a part.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from churnspark.llm.common import arrow_rows, documents_of, words

#: Subset rates: a term is in a subset of a scale with this probability; each scale has SUBSETS_PER_RATE subsets.
RATES = (8, 32, 128, 512, 2048)
SUBSETS_PER_RATE = 16
#: Band of document frequency, as shares of all documents (inverse document frequency 2.3 to 6.9).
MIN_SHARE, MAX_SHARE = 0.001, 0.1
#: A lexicon is at most (distinct words of a mean document) / MIN_SHARE words; a band that allows more is refused.
MAX_LEXICON = 5_000_000
_FLUSH = 400_000


def document_frequency(documents: DataFrame) -> DataFrame:
    """(term, n): number of documents that hold the term; repeats are removed and counts summed inside the task."""
    schema = pa.schema([("term", pa.binary()), ("n", pa.int64())])

    def rows(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(set(words(text.as_py())))
            if len(counts) > _FLUSH:
                yield from counts.items()
                counts = Counter()
        yield from counts.items()

    partial = documents.select("text").mapInArrow(arrow_rows(schema, rows, 65536), "term binary, n bigint")
    return partial.groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(documents: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> list[bytes]:
    """Sorted terms of the band, counted over all documents.

    A term must be in at least ``min_share`` of the documents, so there are at most (mean number of distinct words of
    a document) / min_share terms, whatever the size of the corpus. Beyond MAX_LEXICON an error asks for a narrower
    band; nothing is cut off.
    """
    total = documents.count()
    kept = document_frequency(documents).where(
        (F.col("n") >= F.lit(min_share * total)) & (F.col("n") <= F.greatest(F.lit(max_share * total), F.lit(1.0)))
    )
    terms = [bytes(r["term"]) for r in kept.select("term").limit(MAX_LEXICON + 1).toLocalIterator()]
    if len(terms) > MAX_LEXICON:
        raise ValueError(f"more than {MAX_LEXICON} terms in the band: raise min_share")
    return sorted(terms)


class Fingerprinter:
    """Fingerprints of texts under one lexicon."""

    def __init__(self, terms: list[bytes], seed: int = 1):
        self.rank = {t: i for i, t in enumerate(terms)}
        self.known = frozenset(terms)
        self.ids = np.array([xxhash.xxh64_intdigest(t, seed) for t in terms], np.uint64)
        self.subsets = len(RATES) * SUBSETS_PER_RATE
        owner, member = [], []
        for scale, rate in enumerate(RATES):
            for k in range(SUBSETS_PER_RATE):
                subset = scale * SUBSETS_PER_RATE + k
                drawn = _mix(self.ids + np.uint64((seed * 1000 + subset) * 0x9E3779B97F4A7C15 % 2**64))
                hit = np.flatnonzero(drawn % np.uint64(rate) == 0)
                owner.append(hit)
                member.append(np.full(len(hit), subset, np.int16))
        owner, member = np.concatenate(owner), np.concatenate(member)
        order = np.argsort(owner, kind="stable")
        self.member = member[order]
        self.start = np.searchsorted(owner[order], np.arange(len(terms) + 1))

    def __call__(self, text: str) -> tuple[int, np.ndarray]:
        """Hash of all kept terms, and one 16-bit hash per subset (0: no term of the text is in it).

        A text without any lexicon term falls back to all its words for the first hash.
        """
        found = set(words(text))
        kept = self.known.intersection(found)
        signs = np.zeros(self.subsets, np.uint16)
        if not kept:
            return xxhash.xxh64_intdigest(b" ".join(sorted(found))), signs
        ranks = np.fromiter((self.rank[t] for t in kept), np.int64, len(kept))
        ranks.sort()
        whole = xxhash.xxh64_intdigest(self.ids[ranks].tobytes(), 7)
        begin, count = self.start[ranks], self.start[ranks + 1] - self.start[ranks]
        total = int(count.sum())
        if total:
            within = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            subset = self.member[np.repeat(begin, count) + within]
            order = np.argsort(subset, kind="stable")
            subset, data = subset[order], np.repeat(self.ids[ranks], count)[order].tobytes()
            cuts = np.flatnonzero(np.diff(subset, prepend=-1))
            for s, a, b in zip(subset[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), total]):
                signs[s] = xxhash.xxh32_intdigest(data[8 * a : 8 * b]) % 65535 + 1
        return whole, signs


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """1 if all kept terms agree, else the share of equal hashes among the subsets that either text has terms of."""
    if a[0] == b[0]:
        return 1.0
    used = int(((a[1] | b[1]) != 0).sum())
    return float(((a[1] == b[1]) & (a[1] != 0)).sum()) / used if used else 0.0


def shown(f: tuple[int, np.ndarray]) -> str:
    """Fixed-width hexadecimal form: 16 digits for the whole, 4 per subset."""
    return f"{f[0]:016x}" + f[1].astype(">u2").tobytes().hex()


_LEAST = -(2**63)


def _order():
    """A document's place among all: its id (null first), then the hash of its text."""
    return F.coalesce("doc_id", F.lit(_LEAST)), F.xxhash64("text")


def _place(starts: list[tuple[int, int]]):
    """Number of the range that holds a place."""

    @F.pandas_udf("int")
    def place(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([max(bisect_right(starts, at) - 1, 0) for at in zip(ids.tolist(), hashes.tolist())], dtype="int32")

    return place


def _starts(documents: DataFrame, buckets: int) -> list[tuple[int, int]]:
    """First place of each of at most ``buckets`` consecutive ranges of about equal numbers of rows.

    An id that fills several of them is cut at even steps of the hashes of its texts.
    """
    doc, text = _order()
    cuts = documents.agg(F.percentile_approx(doc, [i / buckets for i in range(buckets)], 20 * buckets)).first()[0]
    if not cuts:
        return []
    wanted = sorted((i, _LEAST + (k << 64) // n) for i, n in Counter(cuts).items() for k in range(n))
    first = documents.select(doc.alias("doc"), text.alias("text")).groupBy(_place(wanted)("doc", "text")).agg(F.min(F.struct("doc", "text")).alias("first"))
    return sorted(tuple(r["first"]) for r in first.collect())


def beside_next(documents: DataFrame, buckets: int | None = None) -> DataFrame:
    """(bucket, peek, doc_id, text) in ascending id order within each bucket; a peek row ends every bucket.

    Places (ids, then hashes of texts) are cut into ranges; the first document of a range is also sent, marked as a
    peek, to the range before it (of the first range: to the last), so each row is followed by its successor in one
    task, with one shuffle of texts and no global window. Null ids come first; rows with equal ids are in the order of
    their texts' hashes, and an id with many texts fills several ranges. Rows equal in both stream through one range.
    """
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts = _starts(documents, buckets or 4 * parts)
    last = max(len(starts) - 1, 0)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def places(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        out = []
        for at in zip(ids.tolist(), hashes.tolist()):
            own = max(bisect_right(starts, at) - 1, 0)
            out.append([own, ~(own - 1 if own else last)] if starts and starts[own] == at else [own])
        return pd.Series(out)

    placed = documents.select("doc_id", "text", F.explode(places(*_order())).alias("place"))
    return (
        placed.select(
            F.when(F.col("place") < 0, F.bitwise_not("place")).otherwise(F.col("place")).alias("bucket"),
            (F.col("place") < 0).alias("peek"),
            "doc_id",
            "text",
        )
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "peek", *_order())
    )


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the text replaced by as many first characters of the next, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """(doc_id, fingerprint) of every text. A null text is empty; equal texts have equal fingerprints."""
    docs = documents_of(df, id_col, text_col)
    terms = docs.sparkSession.sparkContext.broadcast(lexicon(docs, min_share, max_share))
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def rows(batches):
        print_of = Fingerprinter(terms.value)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield doc, shown(print_of(text.as_py()))

    return docs.mapInArrow(arrow_rows(schema, rows), "doc_id bigint, fingerprint string")


def compared(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_SHARE, max_share: float = MAX_SHARE, buckets: int | None = None) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness to the text's own fingerprint.

    One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    A null text is empty, a single document is its own successor, an empty table gives no rows. Null ids come first;
    equal ids are ordered by the hash of their texts.
    """
    docs = documents_of(df, id_col, text_col)
    terms = docs.sparkSession.sparkContext.broadcast(lexicon(docs, min_share, max_share))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
         ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )

    def rows(batches):
        print_of = Fingerprinter(terms.value)
        held = None  # bucket, id, text and fingerprint of the row that waits for its successor
        for batch in batches:
            for bucket, peek, doc, text in zip(*(batch.column(i) for i in range(4))):
                bucket, peek, doc, text = bucket.as_py(), peek.as_py(), doc.as_py(), text.as_py()
                if peek and (held is None or held[0] != bucket):
                    continue  # a further row equal to the one that begins the next range
                own = print_of(text)
                if held is not None and held[0] == bucket:
                    changed = edited(held[2], text)
                    other = print_of(changed)
                    yield (
                        held[1], len(held[2]), hashlib.sha256(changed.encode()).hexdigest(), shown(held[3]), shown(other),
                        likeness(held[3], other), likeness(held[3], own),
                    )
                held = None if peek else (bucket, doc, text, own)

    return beside_next(docs, buckets).mapInArrow(
        arrow_rows(schema, rows, 1024),
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
