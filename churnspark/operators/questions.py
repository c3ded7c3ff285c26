"""Question tables: parsed and rule-made classes, routes, variants and name mentions."""

from __future__ import annotations

import math

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from churnspark.functions.columns import json_object_text, pick, tokens

# Question types, with the words that speak for each; ties go to the earlier type.
DEFAULT_TYPE = "pattern_analysis"
TYPE_WORDS = {
    "risk_assessment": ("risk", "churn risk", "likely", "predict"),
    "pattern_analysis": ("pattern", "trend", "segment", "common", "main reasons"),
    "retention_strategy": ("retain", "retention", "recommend", "strategy", "reduce"),
    "competitive_intel": ("competitor", "switch", "alternative", "lose to"),
}
VALID_TYPES = (*TYPE_WORDS, "general_inquiry")

# Retrieval strategy and number of documents per question type.
ROUTES = {
    "risk_assessment": ("naive", 5),
    "pattern_analysis": ("multi_query", 5),
    "retention_strategy": ("contextual_compression", 5),
    "competitive_intel": ("naive", 7),
}
DEFAULT_ROUTE = ("naive", 5)
# Strategy and number of documents of the research and the writing stage, whatever the question's type.
STAGE_ROUTES = {"research": ("multi_query", 10), "writing": ("reranking", 8)}

# Words that call for outside context.
EXTERNAL_WORDS = "industry|benchmark|trend"


def parse_classification(df: DataFrame, raw: str) -> DataFrame:
    """Fields of a JSON answer; without valid JSON the default type and an error text."""
    schema = "query_type string, customer_id string, entities array<string>, reasoning string, _bad string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = df.withColumn("_p", F.from_json(json_object_text(raw), schema, options))
    bad = F.col("_p").isNull() | F.col("_p._bad").isNotNull()
    return parsed.select(
        *df.columns,
        F.coalesce(F.when(~bad, F.col("_p.query_type")), F.lit(DEFAULT_TYPE)).alias("query_type"),
        F.when(~bad, F.col("_p.customer_id")).alias("customer_id"),
        F.when(~bad, F.col("_p.entities")).alias("entities"),
        F.when(bad, "Query classification error").alias("error"),
    )


def valid_type(label) -> Column:
    """A label made elsewhere, or the default type if it is not a known one."""
    cleaned = F.lower(F.trim(label))
    return F.when(cleaned.isin(*VALID_TYPES), cleaned).otherwise(DEFAULT_TYPE)


def classify(question) -> Column:
    """Type with the most of its words in the question; none at all gives the default type."""
    text = F.lower(question)
    scores = {t: sum(F.when(text.contains(w), 1).otherwise(0) for w in words) for t, words in TYPE_WORDS.items()}
    best = F.greatest(*scores.values())
    return F.when(best > 0, pick(*[(s == best, t) for t, s in scores.items()])).otherwise(DEFAULT_TYPE)


def route(query_type) -> tuple[Column, Column]:
    """(strategy, k) for a question type."""
    chosen = F.col(query_type)
    method = pick(*[(chosen == t, m) for t, (m, _) in ROUTES.items()], default=DEFAULT_ROUTE[0])
    k = pick(*[(chosen == t, k) for t, (_, k) in ROUTES.items()], default=DEFAULT_ROUTE[1])
    return method, k.cast("bigint")


def needs_external(question, query_type, documents) -> Column:
    """Whether outside context is called for: competitive question, too few documents, or a trend word."""
    return (
        (F.col(query_type) == "competitive_intel")
        | (F.col(documents) < 2)
        | F.lower(question).rlike(EXTERNAL_WORDS)
    )


def clauses(question) -> Column:
    """Parts between ``, ; ? .`` and the word "and" that have at least three tokens."""
    parts = F.split(F.col(question), r"[,;?.]| and ")
    return F.filter(parts, lambda p: F.size(tokens(p)) >= 3)


def substrings(text: str, n: str) -> Column:
    """Distinct substrings of ``n`` characters."""
    starts = F.sequence(F.lit(1), F.length(text) - F.col(n) + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(text), i, F.col(n))))


#: Names of one automaton, and their bytes; more names are dealt into several.
MAX_NAMES, MAX_NAME_BYTES = 200_000, 16 * 1024 * 1024


def _found(pieces: list[str], names: list[list[str]]):
    """A function from a text to the names that occur in it: one pass through a trie with failure links."""
    trie = ahocorasick.Automaton()
    for piece, known in zip(pieces, names):
        trie.add_word(piece, known)
    if not pieces:
        return lambda text: ()
    trie.make_automaton()
    return lambda text: {name for _, known in trie.iter(text) for name in known}


def mentions(
    questions: DataFrame, names: DataFrame, key: str, text: str, name: str = "name", ignore_case: bool = True,
    max_names: int = MAX_NAMES,
) -> DataFrame:
    """Names that occur in a text: (key, name), exact, each pair once per row of ``questions``.

    Every text is read once, by an automaton over all names, which is sent to the tasks if measured small. More names
    are dealt by a hash into automata of a bounded size, and every text meets each of them. Null and empty names occur
    nowhere, null texts hold nothing.
    """
    plain = F.lower if ignore_case else F.col
    keyed = names.select(F.col(name).alias("_name")).distinct().withColumn("_piece", plain("_name")).where("_piece <> ''")
    known = keyed.groupBy("_piece").agg(F.sort_array(F.collect_list("_name")).alias("_names"))
    bodies = questions.select(key, plain(text).alias("_body")).where("_body IS NOT NULL")
    out = T.StructType([T.StructField(key, questions.schema[key].dataType), T.StructField(name, names.schema[name].dataType)])
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("_piece")), F.lit(0)).alias("bytes")).first()
    parts = math.ceil(max(size["n"] / max_names, size["bytes"] / MAX_NAME_BYTES))
    if parts <= 1:
        rows = known.collect()
        shared = questions.sparkSession.sparkContext.broadcast(([r["_piece"] for r in rows], [r["_names"] for r in rows]))
        schema = to_arrow_schema(out)

        def search(batches):
            occurring = _found(*shared.value)
            for batch in batches:
                hits = [(i, found) for i, body in enumerate(batch.column(1)) for found in sorted(occurring(body.as_py()))]
                keys = batch.column(0).take(pa.array([i for i, _ in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array([found for _, found in hits], pa.string())], schema=schema)

        return bodies.mapInArrow(search, out)

    def match(names: pd.DataFrame, bodies: pd.DataFrame) -> pd.DataFrame:
        occurring = _found(names["_piece"].tolist(), names["_names"].tolist())
        hits = [(owner, found) for owner, body in zip(bodies[key], bodies["_body"]) for found in sorted(occurring(body))]
        return pd.DataFrame(hits, columns=[key, name])

    # Texts are dealt too, so that a task holds one automaton and a share of the texts.
    slices = max(1, math.ceil(bodies.count() / SLICE_TEXTS))
    by_part = known.withColumn("_part", F.pmod(F.xxhash64("_piece"), F.lit(parts)).cast("int")).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    by_slice = bodies.withColumn("_slice", F.pmod(F.xxhash64("_body"), F.lit(slices)).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return by_part.groupBy("_part", "_slice").cogroup(by_slice.groupBy("_part", "_slice")).applyInPandas(match, out)


#: Mean texts that meet one of several automata in one task.
SLICE_TEXTS = 20_000
