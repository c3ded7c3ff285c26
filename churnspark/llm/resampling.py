"""Importance resampling towards a target text distribution, ranked by parallel sorting by regular sampling.

Features (runs of one or two words) are hashed to buckets; the log ratio of a bucket's smoothed shares in target and
source is its gain, an array that every task holds. A document's weight is the mean gain of its features. Gumbel noise,
drawn from the id, is added, and the highest scores are drawn. Exact ranks come from locally sorted runs, whose regular
samples give the splitters; rows are exchanged by splitter, each segment is merged by itself, and the counts of the
segments before it give its first rank.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from churnspark.llm.check_sql import CRC_TABLE, crc32
from churnspark.llm.common import _WORD_BYTES, arrow_rows, documents_of, free_name
from churnspark.session import materialize

BUCKETS = 10_000
PERCENT, MIN_WORDS, SEED = 25, 20, 7
#: Mean rows of a segment, and regular samples taken for each segment; splitters and samples are all that the driver sees.
SEGMENT_ROWS, SAMPLES = 1_000_000, 16
#: Bytes of a text that are cut into words at a time.
BLOCK = 1 << 20


def word_blocks(text: str, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text in lists, each from about ``block`` bytes: letters, digits and non-ASCII, A-Z in lower case."""
    data = text.encode().translate(_WORD_BYTES)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + block)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def feature_buckets(text: str, buckets: int = BUCKETS, block: int = BLOCK) -> Iterator[np.ndarray]:
    """Buckets of the features of a text: unsigned crc32 of each word and of each two words joined by a space. The
    checksum of two words goes on from that of the first, so no feature is built."""
    crc = zlib.crc32
    last = None  # checksum of the last word of the block before, with a space
    for words in word_blocks(text, block):
        if words:
            ones = [crc(w) for w in words]
            begun = [crc(b" ", c) for c in ones]
            pairs = [crc(w, c) for w, c in zip(words[1:], begun)]
            if last is not None:
                pairs.append(crc(words[0], last))
            last = begun[-1]
            yield np.array(ones + pairs, np.uint32) % buckets


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of a table of one text column each bucket has: an array on the driver, summed in Spark."""

    def rows(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for found in feature_buckets(text.as_py(), buckets):
                    sums += np.bincount(found, minlength=buckets)
        for bucket in np.flatnonzero(sums):
            yield int(bucket), int(sums[bucket])

    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
    summed = texts.mapInArrow(arrow_rows(schema, rows), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in summed.collect():  # at most one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """Add n_words, n_features, weight to a table that has ``text``, which goes."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in kept]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain = held.value
        for batch in batches:
            n_features, weight = [], []
            for text in batch.column(len(names)):
                n = total = 0
                for found in feature_buckets(text.as_py(), len(gain)):
                    n += len(found)
                    total += int(gain[found].sum())
                n_features.append(n)
                weight.append(total // n if n else 0)
            # A text of w words has 2w - 1 features.
            added = [pa.array([(n + 1) // 2 for n in n_features], pa.int64()), pa.array(n_features, pa.int64()), pa.array(weight, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *added], [*names, "n_words", "n_features", "weight"])

    return docs.select(*[F.col(f"`{n}`") for n in names], "text").mapInArrow(run, f"{kinds}, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc, seed: int = SEED):
    """Thousandths of a Gumbel draw, rounded down, from the first 32 bits of a digest of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def _regular_samples(step: int):
    """Every ``step``-th row of a sorted run, from its middle on."""

    def run(batches):
        at = step // 2
        for batch in batches:
            taken = np.arange(at, batch.num_rows, step)
            if len(taken):
                yield batch.take(pa.array(taken))
            at = (taken[-1] + step if len(taken) else at) - batch.num_rows

    return run


def ranked(rows: DataFrame, segment_rows: int = SEGMENT_ROWS, samples: int = SAMPLES) -> DataFrame:
    """Add ``rank`` (1, 2, ...) to a written table of (score, doc_id, tie, ...): highest score first, then smallest
    doc_id (null first), then ``tie``, which tells equal rows apart, so that splitters fall between them as well.

    Parallel sorting by regular sampling. The number of segments follows the number of rows; the driver sees
    ``samples`` keys and one count per segment, and two samples per run at most beside them. A segment is sorted by
    Spark, which spills.
    """
    spark = rows.sparkSession
    key = ["score", "doc_id", "tie"]
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("tie")]
    total = rows.count()
    segments = max(1, math.ceil(total / segment_rows))
    splitters: list[tuple] = []
    if segments > 1:
        runs = rows.select(*key).sortWithinPartitions(*order)
        # At least two samples of a mean run, so that many short runs are sampled as well.
        step = max(1, min(segment_rows // samples, total // max(1, len(rows.inputFiles())) // 2))
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema.fields)
        found = sorted(map(_sort_key, runs.mapInArrow(_regular_samples(step), kinds).collect()))
        splitters = found[len(found) // segments // 2 :: max(1, len(found) // segments)]
    held = spark.sparkContext.broadcast(splitters)
    name = free_name(rows, "segment")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def deal(batches):
        splitters = held.value
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in key))
            part = pa.array([bisect_right(splitters, _sort_key(k)) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, part], [*batch.schema.names, name])

    dealt = rows.mapInArrow(deal, f"{kinds}, `{name}` int") if splitters else rows.withColumn(name, F.lit(0))
    dealt = materialize(dealt, "segments")
    counts = dict(dealt.groupBy(name).agg(F.count("*")).collect())
    before, starts = 0, []
    for segment in range(len(splitters) + 1):
        starts.append((segment, before))
        before += counts.get(segment, 0)
    start = free_name(rows, "start")
    offsets = spark.createDataFrame(starts, f"`{name}` int, `{start}` bigint")
    place = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    merged = dealt.withColumn("rank", place)
    return merged.join(F.broadcast(offsets), name).withColumn("rank", F.col("rank") + F.col(start)).drop(name, start)


def _sort_key(row) -> tuple:
    score, doc, tie = row
    return -score, doc is not None, doc or 0, tie


def resampled(
    df: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_features, weight, score, rank (null where not drawn).

    Of the N rows with at least ``min_words`` words, floor(percent * N / 100) are drawn by score, ties to the smaller
    id, null ids first; equal rows get ranks of their own. ``target`` has a column ``text``. A null or empty text has no
    features and weight 0. A null id draws as the empty id. An empty source gives no rows; an empty target leaves all
    gains to smoothing. Only id and text are read, so other columns cannot clash. The texts are read twice and never
    shuffled; only (id, numbers) of rows that can be drawn are.
    """
    docs = documents_of(df, id_col, text_col)
    gain = gains(bucket_counts(docs.select("text"), buckets), bucket_counts(target.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), buckets))
    scored = weighted(docs, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = materialize(scored.withColumn("tie", F.monotonically_increasing_id()), "scores")
    able = F.col("n_words") >= min_words
    pool = scored.where(able)
    drawn = pool.count() * percent // 100
    placed = ranked(pool, segment_rows)
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank").cast("bigint")))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("bigint"))
    return placed.unionByName(rest).drop("tie")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_FEATURES = "w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"

CHECK_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
texts AS (
    SELECT true AS is_source, doc_id, {_WORDS} AS w FROM documents
    UNION ALL SELECT false, NULL, {_WORDS} FROM benchmark
),
used AS (SELECT is_source, doc_id, len(w) AS n_words, unnest({_FEATURES}) AS feature FROM texts),
hashed AS (SELECT feature, {crc32("feature")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT feature FROM used), crc_table),
totals AS (SELECT count_if(is_source)::DOUBLE AS s_all, count_if(NOT is_source)::DOUBLE AS t_all FROM used),
buckets AS (SELECT bucket, count_if(is_source) AS s, count_if(NOT is_source) AS t FROM used JOIN hashed USING (feature) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (s_all + {BUCKETS}) / ((s + 1.0::DOUBLE) * (t_all + {BUCKETS}))))::BIGINT AS gain FROM buckets, totals),
weights AS (
    SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
    FROM used JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE is_source GROUP BY doc_id
),
scored AS (
    SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || left(sha256('{SEED}:' || d.doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM texts d LEFT JOIN weights g ON g.doc_id = d.doc_id WHERE d.is_source
),
pool AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= {MIN_WORDS})
SELECT s.doc_id, s.n_words::BIGINT AS n_words, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank
FROM scored s LEFT JOIN pool p ON p.doc_id = s.doc_id
"""
