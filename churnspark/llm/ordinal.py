"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= j) = sigmoid(threshold_j - score), with one weight vector over hashed text features for all grades and
ordered thresholds. The expected grade and the probability of the top grade select documents.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from churnspark.llm.common import arrow_rows, documents_of, row_of, words

#: Grade of a rating: quality (0 or 1), plus 1 if it is not toxic.
GRADES = 3
BITS = 18
#: Lengths in bytes of the beginnings of words that are features too; inflected forms share them.
PREFIXES = (4, 5)
#: The model is fitted on at most this many labelled documents, those with the smallest hash of their id.
FIT_ROWS = 8_000
#: A document is accepted if the probability of the top grade reaches this.
ACCEPT = 0.5
#: Classes of the shape of a token: lower-case and non-ASCII letters, capitals, digits; other signs stay.
_CLASSES = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
#: Features of every text: shares of odd tokens, of capitals, of repeated tokens, and whether it has none.
SHARES = (b"odd", b"shouted", b"same", b"empty")
_PLAIN = re.compile(rb"^[Aa0]+(?:['-][Aa0]+)*[,.;:?]?$")


def _slot(kind: bytes, value: bytes) -> int:
    return xxhash.xxh64_intdigest(kind + value) >> (64 - BITS)


def features(text: str) -> dict[int, float]:
    """Hashed features of a whole text: presence of words and of words' first bytes, and shares of token shapes, odd tokens and repeats."""
    raw = text.encode()
    digest, shift = xxhash.xxh64_intdigest, 64 - BITS
    distinct = set(words(text))
    out = dict.fromkeys([digest(w) >> shift for w in distinct], 1.0)
    for n in PREFIXES:
        out.update(dict.fromkeys([digest(w, n) >> shift for w in {w[:n] for w in distinct if len(w) > n}], 1.0))
    shapes = Counter(re.sub(rb"a{2,}", b"a", re.sub(rb"A{2,}", b"A", re.sub(rb"0{2,}", b"0", raw.translate(_CLASSES)))).split())
    total = max(shapes.total(), 1)
    odd = shouted = 0
    for shape, n in shapes.items():
        if n > 0.01 * total:
            out[_slot(b"shape:", shape[:16])] = 1.0 * (n / total) ** 0.5
        if not _PLAIN.match(shape):
            odd += n
        if shape[:1] == b"A" and b"a" not in shape:
            shouted += n
    tokens = raw.split()
    same = sum(map(bytes.__eq__, tokens, tokens[1:]))
    for kind, n in zip(SHARES, (odd, shouted, same, total * (not tokens))):
        out[_slot(b"share:", kind)] = 10.0 * (n / total) ** 0.5
    return out


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Weights by slot and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def grade(self, score: float) -> tuple[float, float]:
        """Expected grade, and the probability of the top grade."""
        above = 1.0 - _sigmoid(self.thresholds - score)
        return float(above.sum()), float(above[-1])


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 250, penalty: float = 1e-3, rate: float = 0.05, least: float = 0.0015, most: float = 0.1) -> Model:
    """Maximum likelihood of (grade, slots, values), in two passes.

    The first pass has a penalty on the weights' sizes and selects features; slots seen in less than the share
    ``least`` of the rows, or once, or in more than the share ``most`` are left out, but for the shares of odd tokens,
    capitals and repeats. Without the common words a score does not grow with the length of a text. The second pass fits the selected features almost without penalty.
    Without rows, or with one grade only, every weight is 0 and the thresholds accept everything.
    """
    grades = np.array([r[0] for r in rows], np.int64)
    if len(np.unique(grades)) < 2:
        return Model(np.zeros(1 << BITS, np.float32), np.linspace(-6.0, -5.0, GRADES - 1))
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[1]) for r in rows])
    slots = np.concatenate([np.asarray(r[1], np.int32) for r in rows])
    values = np.concatenate([np.asarray(r[2], np.float32) for r in rows])
    seen = np.bincount(slots, minlength=1 << BITS)
    chosen = (seen >= max(2, least * len(rows))) & (seen <= most * len(rows))
    chosen[[_slot(b"share:", kind) for kind in SHARES]] = True
    used = np.flatnonzero(chosen & (seen > 0))
    # Only entries of chosen slots are held while fitting.
    keep = chosen[slots]
    row, slots, values = row[keep], slots[keep], values[keep]
    found = _descend(grades, row, slots, values, used, epochs, penalty, rate)[0]
    used = used[np.abs(found) >= 0.02]
    found, thresholds = _descend(grades, row, slots, values, used, 2 * epochs, 1e-6, 2 * rate)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = found
    return Model(weights, thresholds)


def _descend(grades, row, slots, values, used, epochs, penalty, rate):
    """Weights of the slots in ``used`` and thresholds, by Adam over all rows; rare grades weigh more."""
    at = np.full(1 << BITS, -1, np.int32)
    at[used] = np.arange(len(used))
    keep = at[slots] >= 0
    row, column, values = row[keep], at[slots[keep]], values[keep]
    n, size = len(used), len(grades)
    weight = 1.0 / np.bincount(grades, minlength=GRADES).clip(1)
    weight = weight[grades] / weight[grades].mean()
    shares = np.array([(grades <= j).mean() for j in range(GRADES - 1)]).clip(1e-3, 1 - 1e-3)
    first = np.log(shares / (1 - shares))
    # The first threshold, and the logarithms of the gaps between thresholds, so their order is kept.
    p = np.concatenate([np.zeros(n), [first[0]], np.log(np.maximum(np.diff(first), 0.1))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    edge = np.array([-np.inf, *np.zeros(GRADES - 1), np.inf])
    for t in range(1, epochs + 1):
        gaps = np.exp(p[n + 1 :])
        edge[1:-1] = p[n] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(row, values * p[column], size)
        up, low = _sigmoid(edge[grades + 1] - score), _sigmoid(edge[grades] - score)
        up[grades == GRADES - 1], low[grades == 0] = 1.0, 0.0
        inside = np.maximum(up - low, 1e-9)
        d_up, d_low = weight * up * (1 - up) / inside / size, weight * low * (1 - low) / inside / size
        grad = np.zeros_like(p)
        grad[:n] = np.bincount(column, values * (d_up - d_low)[row], n) + penalty * np.tanh(p[:n] / 0.02)
        inner = (np.bincount(grades, d_low, GRADES + 1) - np.bincount(grades + 1, d_up, GRADES + 1))[1:-1]
        grad[n] = inner.sum()
        grad[n + 1 :] = np.cumsum(inner[::-1])[::-1][1:] * gaps
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:n], p[n] + np.concatenate([[0.0], np.cumsum(np.exp(p[n + 1 :]))])


def labelled(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(grade, slots, values) of a bounded sample of labelled documents, whole texts; slots and values as the bytes of
    32-bit arrays. Labels without a quality are skipped."""
    grade = F.coalesce("quality", F.lit(0)) + 1 - F.coalesce("toxic", F.lit(0))
    kept = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(grade).alias("grade"))
    order = F.xxhash64("doc_id", F.lit(17))
    sample = kept.orderBy(order, "doc_id").limit(rows)
    schema = pa.schema([("grade", pa.int32()), ("slots", pa.binary()), ("values", pa.binary())])

    def featured(batches):
        for batch in batches:
            for g, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = features(text.as_py())
                yield g, np.fromiter(found, np.int32, len(found)).tobytes(), np.fromiter(found.values(), np.float32, len(found)).tobytes()

    # The sample is at most ``rows`` pairs of integers, so it may be broadcast and no text is shuffled.
    return documents.join(F.broadcast(sample), "doc_id").select("grade", "text").mapInArrow(arrow_rows(schema, featured, 256), "grade int, slots binary, values binary")


def train(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, **options) -> Model:
    """Fit on a bounded sample. The order of collected rows is made the same in every run."""
    found = labelled(documents, labels, rows).collect()
    found.sort(key=lambda r: (r["grade"], r["slots"], r["values"]))
    return fit([(r["grade"], np.frombuffer(r["slots"], np.int32), np.frombuffer(r["values"], np.float32)) for r in found], **options)


def graded(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, accept: float = ACCEPT, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, expected_grade, top_probability, accepted) of every row; the columns named in ``extra``
    come along as one struct ``row``.

    A null text is empty and graded like any other text. Repeated rows and null ids stay; labels that repeat take
    their lowest grade; labels of unknown documents are ignored. An empty table gives no rows.
    """
    docs = documents_of(df, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fit_rows))
    carried = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(extra)]
    source = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *carried)
    kinds = dict(df.dtypes)
    columns = "doc_id bigint, expected_grade double, top_probability double, accepted boolean" + "".join(f", _{i} {kinds[c]}" for i, c in enumerate(extra))

    def run(batches):
        fitted = model.value
        for batch in batches:
            expected, top = [], []
            for text in batch.column(1):
                found = features(text.as_py())
                score = float(fitted.weights[np.fromiter(found, np.int64, len(found))] @ np.fromiter(found.values(), np.float64, len(found)))
                e, t = fitted.grade(score)
                expected.append(e)
                top.append(t)
            accepted = [t >= accept for t in top]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(expected, pa.float64()), pa.array(top, pa.float64()), pa.array(accepted, pa.bool_()), *batch.columns[2:]],
                names=["doc_id", "expected_grade", "top_probability", "accepted", *batch.schema.names[2:]],
            )

    out = source.mapInArrow(run, columns)
    return out.select("doc_id", "expected_grade", "top_probability", "accepted", *row_of(extra))
