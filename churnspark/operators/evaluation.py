"""Relevance, evaluation metrics and strategy comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from churnspark.functions.columns import TOKEN_SEPARATOR, pick, prettify, tokens
from churnspark.operators.index import BATCH_TERMS, TOKEN, TextIndex, idf
from churnspark.operators.questions import substrings
from churnspark.operators.sizing import fits
from churnspark.session import materialize

#: Tokens in the key that pairs a passage with the texts that may contain it.
GRAM = 6
#: Odd multiplier that mixes the hashes of a run's words.
MIX = np.uint64(0x9E3779B97F4A7C15)


def _gram_rows(texts: DataFrame, key: str, sizes: list[int], wanted: DataFrame | None = None, edges: int = 0) -> DataFrame:
    """(key, _size, _gram): hashes of every run of ``size`` words of the texts (key, text), each once in a text.

    Words are hashed once and a run's hash is made of theirs, so equal runs have equal hashes. With ``wanted`` (_size,
    _gram), measured small, only these are given. With ``edges`` words are left out at both ends, and a text of fewer
    words than the largest size has runs of all its words.
    """
    schema = T.StructType([texts.schema[key], T.StructField("_size", T.IntegerType()), T.StructField("_gram", T.LongType())])
    arrow = to_arrow_schema(schema)
    shared = None
    if wanted is not None:
        by_size: dict[int, list[int]] = {}
        for r in wanted.collect():
            by_size.setdefault(r["_size"], []).append(r["_gram"])
        shared = texts.sparkSession.sparkContext.broadcast({size: np.array(sorted(grams), dtype=np.int64) for size, grams in by_size.items()})

    def part(words: list[str], counts: list[int], owners: pa.Array) -> Iterator[pa.RecordBatch]:
        hashed = pd.util.hash_array(np.array(words, dtype=object), categorize=True)
        count = np.array(counts)
        text_of = np.repeat(np.arange(len(count)), count)
        left = np.repeat(np.cumsum(count), count) - np.arange(len(words))
        for size in sizes:
            run = left >= size
            if edges and size < max(sizes):
                run &= count[text_of] == size
            at = np.flatnonzero(run)
            gram = np.zeros(len(at), dtype=np.uint64)
            for i in range(size):
                gram = (gram ^ hashed[at + i]) * MIX
                gram ^= gram >> np.uint64(29)
            gram = gram.view(np.int64)
            if shared is not None:
                known = shared.value.get(size, np.zeros(0, dtype=np.int64))
                place = np.minimum(np.searchsorted(known, gram), max(len(known) - 1, 0))
                met = known[place] == gram if len(known) else np.zeros(len(gram), dtype=bool)
                at, gram = at[met], gram[met]
            order = np.lexsort([gram, text_of[at]])
            owner, gram = text_of[at][order], gram[order]
            once = np.ones(len(gram), dtype=bool)
            once[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
            owner, gram = owner[once], gram[once]
            if len(gram):
                columns = [owners.take(pa.array(owner)), pa.array(np.full(len(gram), size, dtype=np.int32)), pa.array(gram)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts, begin = [], [], 0
            for row, body in enumerate(batch.column(1)):
                found = TOKEN.findall(body.as_py() or "")
                found = found[edges : max(len(found) - edges, edges)] if edges else found
                words += found
                counts.append(len(found))
                if len(words) > BATCH_TERMS:
                    yield from part(words, counts, batch.column(0).slice(begin, len(counts)))
                    words, counts, begin = [], [], row + 1
            if words:
                yield from part(words, counts, batch.column(0).slice(begin, len(counts)))

    return texts.select(key, "text").mapInArrow(cut, schema)


def passage_runs(passages: DataFrame) -> DataFrame:
    """(question_id, _size, _gram): runs of a passage's inner words, all but the first and the last."""
    return materialize(_gram_rows(passages, "question_id", list(range(1, GRAM + 1)), edges=1), "runs")


def rarest_runs(texts: DataFrame, passages: DataFrame, runs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs (doc_id, _size, _gram) of texts that some passage has, and for each passage (question_id, _size, _gram) the
    run of its inner words that the fewest texts have.

    ``texts`` are (doc_id, text), ``passages`` (question_id, text), ``runs`` their ``passage_runs``. A passage with a run that no text has occurs in none
    and is left out. An opening that many passages share is a key only for a passage that has nothing rarer.
    """
    runs = passage_runs(passages) if runs is None else runs
    wanted = runs.select("_size", "_gram").distinct()
    sizes = sorted(r["_size"] for r in runs.select("_size").distinct().collect())  # at most GRAM
    small = fits(wanted)
    met = _gram_rows(texts, "doc_id", sizes, wanted if small else None)
    met = materialize(met if small else met.join(wanted, ["_size", "_gram"], "left_semi"), "met")
    counted = met.groupBy("_size", "_gram").agg(F.count("*").alias("df"))
    rated = runs.join(F.broadcast(counted) if fits(counted) else counted, ["_size", "_gram"], "left")
    rarest = rated.groupBy("question_id").agg(F.min(F.struct("df", "_size", "_gram")).alias("run"), F.count_if(F.col("df").isNull()).alias("unknown"))
    return met, rarest.where("unknown = 0").select("question_id", "run._size", "run._gram")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, TOKEN_SEPARATOR), lambda t: t != "")


def contained(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, question_id) where a text contains a passage, exact, without a nested loop.

    A passage's inner words appear unbroken in any text that contains it, so every run of up to six of them is in the
    text. The run that the fewest texts have is the equi-join key (``rarest_runs``), and pairs are verified on the full
    texts. Passages without an inner word are found by their exact length instead.
    """
    runs = passage_runs(passages)
    met, rarest = rarest_runs(texts, passages, runs)
    keyed = F.broadcast(rarest) if fits(rarest) else rarest
    pairs = met.join(keyed, ["_size", "_gram"]).select("doc_id", "question_id").distinct()

    keyless = passages.join(runs.select("question_id").distinct(), "question_id", "left_anti")
    short = keyless.filter(F.length("text") > 0).select("question_id", F.col("text").alias("_piece"))
    lengths = short.agg(F.collect_set(F.length("_piece"))).scalar()
    sized = texts.select("doc_id", "text", F.explode(lengths).alias("_n")).filter(F.col("_n") <= F.length("text"))
    exact = (
        sized.select("doc_id", F.explode(substrings("text", "_n")).alias("_piece"))
        .join(short, "_piece")
        .select("doc_id", "question_id")
    )
    # Only documents with a pair are verified; their ids go to the texts if measured small.
    pairs = materialize(pairs, "pairs")
    ids = pairs.select("doc_id").distinct()
    ids = F.broadcast(ids) if fits(ids) else ids
    verified = (
        texts.select("doc_id", "text")
        .join(ids, "doc_id", "left_semi")
        .join(pairs, "doc_id")
        .join(passages.select("question_id", F.col("text").alias("_passage")), "question_id")
        .filter(F.contains("text", "_passage"))
        .select("doc_id", "question_id")
    )
    return verified.unionByName(exact).distinct()


def evaluation_set(
    golden: DataFrame, hits: DataFrame, methods: list[str], answers: DataFrame | None = None
) -> DataFrame:
    """(method, question_id, question, contexts, answer, ground_truth) for every method and question.

    Contexts are in rank order; a question without hits keeps its row with an empty list.
    ``answers`` (method, question_id, answer) are written elsewhere; without them the first
    context stands in.
    """
    listed = hits.groupBy("method", "question_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda e: e["text"]).alias("contexts")
    )
    every = golden.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    joined = every.join(listed, ["method", "question_id"], "left")
    contexts = F.coalesce("contexts", F.array().cast("array<string>"))
    first = F.try_element_at("contexts", F.lit(1))
    if answers is not None:
        joined = joined.join(answers.withColumnRenamed("answer", "_written"), ["method", "question_id"], "left")
        first = F.col("_written")
    return joined.select(
        "method",
        "question_id",
        "question",
        contexts.alias("contexts"),
        F.coalesce(first, F.lit("")).alias("answer"),
        "ground_truth",
    )


def precision_recall(hits: DataFrame, relevant: DataFrame, questions: DataFrame, methods: list[str]) -> DataFrame:
    """(method, question_id, context_precision, context_recall) over questions with relevant documents."""
    totals = relevant.groupBy("question_id").agg(F.count("*").alias("_relevant"))
    marked = hits.join(relevant.withColumn("_r", F.lit(1)), ["question_id", "doc_id"], "left").withColumn(
        "_r", F.coalesce("_r", F.lit(0))
    )
    so_far = F.sum("_r").over(W.partitionBy("method", "question_id").orderBy("rank"))
    per_question = (
        marked.withColumn("_at", F.col("_r") * so_far / F.col("rank"))
        .groupBy("method", "question_id")
        .agg(
            (F.sum("_at") / F.nullif(F.sum("_r"), F.lit(0))).alias("p"),
            F.countDistinct(F.when(F.col("_r") == 1, F.col("doc_id"))).alias("found"),
        )
    )
    every = totals.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    return every.join(per_question, ["method", "question_id"], "left").select(
        "method",
        "question_id",
        F.coalesce("p", F.lit(0.0)).alias("context_precision"),
        (F.coalesce("found", F.lit(0)) / F.col("_relevant")).alias("context_recall"),
    )


def text_overlap(pairs: DataFrame, keys: list[str], index: TextIndex | None = None) -> DataFrame:
    """Lexical measures of (question, contexts, answer, ground_truth) rows, by counting terms per row.

    ``support_ratio``: answer tokens found in the contexts. ``question_overlap``: question terms found
    in the answer. ``token_f1``: answer against ground truth. With an index also
    ``semantic_similarity``: TF-IDF cosine of answer and ground truth.
    """
    sides = {"q": "question", "a": "answer", "t": "ground_truth", "c": F.array_join("contexts", "\n")}

    def marked(side, text):
        return F.transform(tokens(text), lambda w: F.struct(F.lit(side).alias("side"), w.alias("term")))

    long = pairs.select(*keys, F.explode(F.concat(*[marked(s, t) for s, t in sides.items()])).alias("w"))
    counted = long.groupBy(*keys, F.col("w.term").alias("term")).agg(
        *[F.count_if(F.col("w.side") == s).alias(s) for s in sides]
    )
    q, a, t, c = (F.col(s) for s in sides)
    measures = {
        "support_ratio": F.sum(F.when(c > 0, a).otherwise(0)) / F.nullif(F.sum(a), F.lit(0)),
        "question_overlap": F.count_if((q > 0) & (a > 0)) / F.nullif(F.count_if(q > 0), F.lit(0)),
        "token_f1": 2 * F.sum(F.least(a, t)) / F.nullif(F.sum(a) + F.sum(t), F.lit(0)),
    }
    if index is not None:
        weight = idf(F.lit(index.n), F.coalesce("df", F.lit(0)))
        counted = counted.join(index.terms.select("term", "df"), "term", "left").withColumn("_w", weight * weight)
        w = F.col("_w")
        norm = F.sqrt(F.sum(a * a * w)) * F.sqrt(F.sum(t * t * w))
        measures["semantic_similarity"] = F.sum(a * t * w) / F.nullif(norm, F.lit(0.0))
    found = counted.groupBy(*keys).agg(*[F.coalesce(m, F.lit(0.0)).alias(name) for name, m in measures.items()])
    return pairs.select(*keys).join(found, keys, "left").fillna(0.0, list(measures))


def method_means(samples: DataFrame, metrics: list[str], places: int = 4) -> DataFrame:
    """Mean of every metric per method."""
    return samples.groupBy("method").agg(*[F.round(F.avg(m), places).alias(m) for m in metrics])


def best_per_metric(means: DataFrame, metrics: list[str]) -> DataFrame:
    """Method with the highest mean per metric; ties to the smaller name."""
    long = means.unpivot("method", metrics, "metric", "score")
    return long.groupBy("metric").agg(
        F.max("score").alias("best"), F.min_by("method", F.struct(-F.col("score"), "method")).alias("method")
    ).select("metric", "method", F.col("best").alias("score"))


def overall_mean(metrics: list[str]) -> Column:
    """Mean of the metrics that are present."""
    present = F.filter(F.array(*metrics), lambda m: m.isNotNull())
    return F.round(F.aggregate(present, F.lit(0.0), lambda s, m: s + m) / F.size(present), 6)


def best_overall(means: DataFrame, metrics: list[str]) -> DataFrame:
    ranked = means.select("method", overall_mean(metrics).alias("score"))
    return ranked.orderBy(F.desc("score"), "method").limit(1)


def versus_baseline(means: DataFrame, metrics: list[str], baseline: str = "naive") -> DataFrame:
    """Relative improvement of every method over the baseline, percent."""
    long = means.unpivot("method", metrics, "metric", "score")
    base = long.filter(F.col("method") == baseline).select("metric", F.col("score").alias("base"))
    change = F.round((F.col("score") - F.col("base")) / F.nullif("base", F.lit(0.0)) * 100, 4)
    return long.join(base, "metric").select("method", "metric", "score", change.alias("improvement"))


def as_percentages(means: DataFrame, metrics: list[str]) -> DataFrame:
    """Readable method names and metrics as percentages with one decimal; missing ones are zero."""
    return means.select(
        prettify("method").alias("method"),
        *[F.round(F.coalesce(m, F.lit(0.0)) * 100, 1).alias(m) for m in metrics],
    )


def colour(metric: str, score: str) -> Column:
    """Colour band of a percentage; accuracy metrics are judged more strictly."""
    # Strict metrics and thresholds.
    strict = F.col(metric).isin("faithfulness", "support_ratio", "context_precision")
    high = F.when(strict, 85).otherwise(75)
    low = F.when(strict, 70).otherwise(60)
    return pick((F.col(score) >= high, "green"), (F.col(score) >= low, "yellow"), default="red")


def plain_colour(score: str) -> Column:
    """Colour band of a 0..1 score."""
    return pick((F.col(score) >= 0.8, "green"), (F.col(score) >= 0.6, "yellow"), default="red")
