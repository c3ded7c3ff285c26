"""Retrieval strategies over a chunked corpus, for a table of questions.

Every strategy maps (retriever, questions, k) to rows of question_id, method, rank, doc_id,
parent_no, child_no, score and text. Questions are rows of question_id and text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from churnspark.functions.columns import sentences, tokens
from churnspark.operators import chunking
from churnspark.operators import index as I
from churnspark.operators.questions import clauses
from churnspark.operators.ranking import top_per_group
from churnspark.operators.sizing import fits
from churnspark.session import materialize

CHILD_KEYS = ["doc_id", "parent_no", "child_no"]
PARENT_KEYS = ["doc_id", "parent_no"]

# Candidates per result in reranking, share of question terms a kept sentence has,
# and the number of keywords in the keyword variant.
OVERFETCH = 3
MIN_OVERLAP = 0.2
KEYWORDS = 5


@dataclass(frozen=True)
class Retriever:
    """A corpus of (doc_id, text) with its chunk index; ``allowed`` restricts the documents searched."""

    documents: DataFrame
    cutter: Callable = chunking.fixed
    allowed: DataFrame | None = None
    fetched: DataFrame | None = None

    @cached_property
    def index(self) -> I.TextIndex:
        return I.build(self.documents, CHILD_KEYS, self.children)

    def children(self, documents: DataFrame) -> DataFrame:
        return chunking.two_tier(documents, ["doc_id"], "text", self.cutter)

    def parents(self, documents: DataFrame) -> DataFrame:
        return chunking.parents(documents, ["doc_id"], "text", self.cutter)

    def restricted(self, allowed: DataFrame) -> Retriever:
        """Same corpus statistics, but only these documents (doc_id) can be found."""
        return replace(self, allowed=allowed)

    def best(self, asked: DataFrame, k: int, parents: bool) -> DataFrame:
        """Best children (and parents) of variants (question_id, variant, text)."""
        index = self.index
        if self.allowed is not None:
            index = index.within(self.allowed)
        return I.best(index, asked, ["question_id", "variant"], k, parents)

    def matching(self, hits: DataFrame) -> DataFrame:
        """Documents with a hit. Their ids go to the texts if measured small, so texts are not shuffled."""
        ids = hits.select("doc_id").distinct()
        return self.documents.join(F.broadcast(ids) if fits(ids) else ids, "doc_id", "left_semi")

    def holding(self, *hits: DataFrame) -> Retriever:
        """The same retriever with the documents of all these hits written once, for several strategies."""
        ids = hits[0].select("doc_id")
        for other in hits[1:]:
            ids = ids.union(other.select("doc_id"))
        return replace(self, fetched=materialize(self.matching(ids), "fetched"))

    def texts(self, hits: DataFrame, cut: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
        """Add the chunk text to hits: only documents with a hit are cut again."""
        return hits.join(cut(self.fetched if self.fetched is not None else self.matching(hits)), keys)


def original(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", F.lit(0).alias("variant"), "text")


def variants(index: I.TextIndex, questions: DataFrame) -> DataFrame:
    """The question, its rarest terms, and each of its clauses."""
    rare = I.term_counts(questions, ["question_id"]).join(index.terms, "term")
    top = top_per_group(rare, "question_id", [F.desc(F.round("idf", 9)), "term"], KEYWORDS, "_rank")
    words = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "term"))), lambda e: e["term"])
    keywords = top.groupBy("question_id").agg(F.lit(1).alias("variant"), F.array_join(words, " ").alias("text"))
    parts = questions.select("question_id", F.posexplode(clauses("text")).alias("at", "text")).select(
        "question_id", (F.col("at") + 2).alias("variant"), "text"
    )
    return original(questions).unionByName(keywords).unionByName(parts)


@dataclass(frozen=True)
class Candidates:
    """Best children per question variant, and best parents per question."""

    children: DataFrame
    parents: DataFrame
    k: int


def find(
    retriever: Retriever, questions: DataFrame, k: int, with_variants=True, with_parents=True, own: DataFrame | None = None
) -> Candidates:
    """One scoring pass from which every strategy picks; the few rows it yields are written, as they are read
    to fetch texts and by each strategy. ``own`` (question_id, variant from 1, text) replaces the derived variants."""
    if own is not None:
        asked = original(questions).unionByName(own.select("question_id", F.col("variant").cast("int").alias("variant"), "text"))
    else:
        asked = variants(retriever.index, questions) if with_variants else original(questions)
    top = materialize(retriever.best(asked, OVERFETCH * k, with_parents), "candidates")
    children = top.filter("kind = 'child'").drop("kind")
    parents = top.filter("kind = 'parent'").select("question_id", *PARENT_KEYS, "score", "rank")
    return Candidates(children, parents, k)


def _finish(hits: DataFrame, method: str) -> DataFrame:
    child = "child_no" if "child_no" in hits.columns else F.lit(None).cast("bigint").alias("child_no")
    return hits.select(
        "question_id", F.lit(method).alias("method"), "rank", "doc_id", "parent_no", child, "score", "text"
    )


def naive(retriever: Retriever, questions: DataFrame, k: int = 5, found: Candidates | None = None) -> DataFrame:
    """The k children most similar to the question."""
    found = found or find(retriever, questions, k, with_variants=False, with_parents=False)
    hits = found.children.filter((F.col("variant") == 0) & (F.col("rank") <= k))
    return _finish(retriever.texts(hits, retriever.children, CHILD_KEYS), "naive")


def multi_query(
    retriever: Retriever, questions: DataFrame, k: int = 5, found: Candidates | None = None, own: DataFrame | None = None
) -> DataFrame:
    """k children per variant of the question, each child once with its best score.

    ``own`` are the caller's variants (question_id, variant from 1, text) in place of the derived ones.
    """
    found = found or find(retriever, questions, k, with_parents=False, own=own)
    merged = (
        found.children.filter(F.col("rank") <= k)
        .groupBy("question_id", *CHILD_KEYS)
        .agg(F.max("score").alias("score"))
    )
    # At most k rows per variant, so the ranked group is bounded by the question's own length.
    order = W.partitionBy("question_id").orderBy(*I.best_first(CHILD_KEYS))
    hits = merged.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return _finish(retriever.texts(hits, retriever.children, CHILD_KEYS), "multi_query")


def parent_document(retriever: Retriever, questions: DataFrame, k: int = 5, found: Candidates | None = None) -> DataFrame:
    """The k distinct parents of the most similar children."""
    found = found or find(retriever, questions, k, with_variants=False)
    hits = found.parents.filter(F.col("rank") <= k)
    return _finish(retriever.texts(hits, retriever.parents, PARENT_KEYS), "parent_document")


def kept_sentences(text: str, question: str, least: float = MIN_OVERLAP) -> Column:
    """Sentences of a text that share enough of the question's distinct terms, joined."""
    asked = F.array_distinct(tokens(question))
    return F.array_join(
        F.filter(
            sentences(text),
            lambda s: F.size(F.array_intersect(tokens(s), asked)) / F.size(asked) >= least,
        ),
        " ",
    )


def contextual_compression(
    retriever: Retriever, questions: DataFrame, k: int = 5, found: Candidates | None = None
) -> DataFrame:
    """Naive hits cut down to the sentences that bear on the question; empty ones drop out."""
    hits = naive(retriever, questions, k, found)
    asked = questions.select("question_id", F.col("text").alias("_question"))
    cut = hits.join(asked, "question_id").withColumn("text", kept_sentences("text", "_question"))
    return _finish(cut.filter("text <> ''"), "contextual_compression")


def reranking(
    retriever: Retriever,
    questions: DataFrame,
    k: int = 5,
    found: Candidates | None = None,
    scorer: Column | None = None,
) -> DataFrame:
    """3k children by similarity, reordered by a second scorer (BM25), best k kept.

    ``scorer`` may be any column over the candidates (a Python one should be ``guarded``); without one BM25 is used,
    which was summed in the same pass as the similarity. A question for which the scorer gives a null or NaN score for
    any candidate is answered by contextual compression instead.
    """
    found = found or find(retriever, questions, k, with_variants=False, with_parents=False)
    pool = found.children.filter((F.col("variant") == 0) & (F.col("rank") <= OVERFETCH * k)).drop("rank")
    pool = pool.withColumn("_second", scorer.cast("double") if scorer is not None else F.col("bm25"))
    order = [F.desc(F.round("_second", 9)), *I.best_first(CHILD_KEYS)]
    if scorer is None:
        hits = top_per_group(pool, "question_id", order, k).withColumn("score", F.col("_second"))
        return _finish(retriever.texts(hits, retriever.children, CHILD_KEYS), "reranking")
    pool = materialize(pool, "reranked")
    failed = pool.where(F.col("_second").isNull() | F.isnan("_second")).select("question_id").distinct()
    sure = pool.join(failed, "question_id", "left_anti")
    hits = top_per_group(sure, "question_id", order, k).withColumn("score", F.col("_second"))
    reranked = _finish(retriever.texts(hits, retriever.children, CHILD_KEYS), "reranking")
    others = contextual_compression(retriever, questions.join(failed, "question_id", "left_semi"), k, found)
    return reranked.unionByName(_finish(others.join(failed, "question_id", "left_semi"), "reranking"))


def guarded(score: Callable, *columns: str) -> Column:
    """A second scorer from a Python function of whole columns (pandas Series) to scores: where the function fails, the
    scores of that batch are null, so its questions fall back."""

    def safely(*series: pd.Series) -> pd.Series:
        try:
            return pd.Series(score(*series), dtype="float64")
        except Exception:  # whatever a scorer raises, the question still gets an answer
            return pd.Series([None] * len(series[0]), dtype="float64")

    return F.pandas_udf(safely, "double")(*columns)


STRATEGIES: dict[str, Callable] = {
    "naive": naive,
    "multi_query": multi_query,
    "contextual_compression": contextual_compression,
    "parent_document": parent_document,
    "reranking": reranking,
}


def strategy(name: str) -> Callable:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; known: {', '.join(STRATEGIES)}")
    return STRATEGIES[name]


def run(retriever: Retriever, questions: DataFrame, k: int = 5, names=tuple(STRATEGIES)) -> DataFrame:
    """Several strategies over one scoring pass and one fetch of texts, stacked."""
    chosen = [strategy(n) for n in names]
    found = find(retriever, questions, k)
    retriever = retriever.holding(found.children, found.parents)
    out = chosen[0](retriever, questions, k, found)
    for other in chosen[1:]:
        out = out.unionByName(other(retriever, questions, k, found))
    return out


#: Filters of a question on a profile: (question column, profile column, comparison).
FILTERS = (("segment", "segment", "=="), ("churn_reason", "churn_reason", "=="), ("arr_from", "arr_lost", ">="), ("arr_to", "arr_lost", "<="))


def filtered(profiles: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """(question_id, doc_id, score, rank): the k best profiles that meet each question's own filters.

    ``profiles`` has doc_id, text and metadata (segment, churn_reason, arr_lost). ``questions`` has question_id, text,
    segment, churn_reason, arr_from, arr_to; NULL is no filter, 0 is a bound like any other. Filters are applied to
    the scores inside the scoring task.
    """
    index = I.build(profiles.select("doc_id", "text"), ["doc_id"])
    known = profiles.select("doc_id", "metadata.segment", "metadata.churn_reason", "metadata.arr_lost")
    index = replace(index, stored=index.stored.join(known, "doc_id"), postings=None)
    asked = questions.select("question_id", "text")
    conditions = questions.select("question_id", *[q for q, _, _ in FILTERS])
    top = I.best(index, asked, ["question_id"], k, conditions=conditions, filters=FILTERS)
    return top.select("question_id", "doc_id", "score", "rank")


def contexts(hits: DataFrame, by: list[str], limit: int | None = None, width: int | None = None) -> DataFrame:
    """Numbered context text per question, in rank order."""
    chosen = hits.filter(F.col("rank") <= limit) if limit else hits
    text = F.substring("text", 1, width) if width else F.col("text")
    ordered = F.array_sort(F.collect_list(F.struct("rank", text.alias("text"))))
    numbered = F.transform(
        ordered, lambda e, i: F.concat(F.lit("[Document "), (i + 1).cast("string"), F.lit("]\n"), e["text"])
    )
    return chosen.groupBy(*by).agg(F.count("*").alias("documents"), F.array_join(numbered, "\n\n").alias("context"))


def labelled_contexts(hits: DataFrame, label: Column, limit: int = 3, width: int = 500) -> DataFrame:
    """At most ``limit`` documents per question under their source labels, cut to ``width`` characters."""
    # Heading and line formats.
    body = F.concat(label, F.lit(":\n"), F.substring("text", 1, width), F.lit("...\n"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", body.alias("body"))))
    lines = F.transform(ordered, lambda e, i: F.concat(F.lit("\n"), (i + 1).cast("string"), F.lit(". "), e["body"]))
    heading = F.lit("**Relevant Historical Context:**\n\n")
    return (
        hits.filter(F.col("rank") <= limit)
        .groupBy("question_id")
        .agg(F.concat(heading, F.array_join(lines, "\n")).alias("context"))
    )


# External pages ----------------------------------------------------------------------------------

# Prefixes of the derived external queries, results kept per query.
EXTERNAL_PREFIXES = (
    "SaaS customer churn",
    "customer retention best practices",
    "churn analysis industry trends",
)
PER_EXTERNAL_QUERY = 2


def visible_text(html) -> Column:
    """Text of a page without scripts, styles and tags."""
    no_code = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(no_code, r"<[^>]*>", " "), r"\s+", " "))


def external(pages: DataFrame, questions: DataFrame) -> DataFrame:
    """The best pages for each derived query: (question_id, query_no, rank, page_id, url, score)."""
    readable = pages.select("page_id", visible_text("html").alias("text"))
    prefixes = F.array(*[F.lit(p) for p in EXTERNAL_PREFIXES])
    derived = questions.select("question_id", F.posexplode(prefixes).alias("query_no", "_prefix"), "text").select(
        "question_id", "query_no", F.concat_ws(" ", "_prefix", "text").alias("text")
    )
    index = I.build(readable, ["page_id"])
    top = I.best(index, derived, ["question_id", "query_no"], PER_EXTERNAL_QUERY).drop("kind", "bm25")
    return top.join(pages.select("page_id", "url"), "page_id")
