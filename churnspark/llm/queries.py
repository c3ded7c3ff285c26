"""The operators as named queries over the tables of one folder, and check SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from churnspark.llm import (
    best_fit, bwt_repeats, char_lm, conversation_repair, external_shuffle, html_density, imatch, ordinal, resampling, simhash, token_cache, url_rules, winnowing,
)
from churnspark.llm.common import free_name


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every text and of its edited text."""
    return imatch.compared(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and components of near copies."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_density.extract(_table(spark, sf_dir, "pages"))


def op4_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 and slots of all documents."""
    return external_shuffle.external_shuffle(_table(spark, sf_dir, "documents"), 40)


def op5_char_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text."""
    return char_lm.identified(_table(spark, sf_dir, "documents"))


def op6_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every text without the 400-byte strings that occur twice."""
    return bwt_repeats.without_repeats(_table(spark, sf_dir, "documents"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return best_fit.packed(_table(spark, sf_dir, "documents"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that occur in a benchmark window."""
    return winnowing.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return url_rules.judge(_table(spark, sf_dir, "pages"))


def op10_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of every document, and whether it is accepted."""
    return ordinal.graded(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every conversation after planted damage."""
    rows = conversation_repair.damaged(_table(spark, sf_dir, "conversations"))
    return conversation_repair.digested(conversation_repair.repaired(rows, "present"))


def op12_regular_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark's distribution, ranked by score."""
    return resampling.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, through a cache that starts empty."""
    return token_cache.token_counts(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_imatch, op2_simhash, op3_html_density, op4_external_shuffle, op5_char_lm, op6_bwt_repeats, op7_best_fit, op8_winnowing, op9_url_rules, op10_ordinal,
        op11_prefix_doubling, op12_regular_sampling, op13_digest_cache,
    )
}

CHECKS = {
    "op9_url_rules": url_rules.CHECK_SQL,
    "op11_prefix_doubling": conversation_repair.CHECK_SQL,
    "op12_regular_sampling": resampling.CHECK_SQL,
}


# Stages of the pipeline: documents in, documents of the same columns out, but for the last.


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    graded = ordinal.graded(docs, _table(spark, sf_dir, "labels"), extra=tuple(docs.columns))
    return graded.where("accepted").select("row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word Jaccard similarity of 0.8 or more): the one with the
    smallest id, and of rows that share it, the smallest key of the text; of rows equal in both, one. Rows that share an
    id, or have none, but not their text are represented each by a row of its own component."""
    # One key for the join and for repeated rows, so that texts are placed once.
    name = free_name(docs, "_key")
    kept = simhash.representatives(docs).withColumnRenamed("row_key", name)
    return docs.withColumn(name, simhash.row_key()).join(kept, name, "left_semi").dropDuplicates([name]).drop(name)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of PASSAGE_BYTES or more that occur twice; every document stays. Bytes of a
    character that a cut leaves incomplete go as well."""
    others = tuple(c for c in docs.columns if c != "text")
    cut = bwt_repeats.without_repeats(docs, length=PASSAGE_BYTES, k=PASSAGE_GRAM, extra=others)
    length = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    changed = {"text": F.col("kept_text"), "n_chars": length}
    return cut.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


#: A passage of over 50 words has more bytes than this if its words have three letters on average.
PASSAGE_BYTES, PASSAGE_GRAM = 200, 64


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    mark = free_name(docs, "_contaminated")
    return winnowing.marked(docs, _table(spark, sf_dir, "benchmark"), mark).where(~F.col(mark)).drop(mark)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return best_fit.packed(docs)
