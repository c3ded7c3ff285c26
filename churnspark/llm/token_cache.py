"""Token counts through a digest cache.

The cache is a Parquet folder of (tokenizer, digest, n_tokens): the digest of a tokenizer's version, the digest of a
normalised text, and the stored count. Texts are joined with it by digest; only distinct texts that it lacks are
encoded, and their counts are appended before the result is read from it.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from churnspark.llm.common import documents_of
from churnspark.operators.sizing import fits
from churnspark.session import fresh_path, materialize

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Characters that are cut into pieces at a time, so that a task holds the pieces of no more than these.
BLOCK = 1 << 18
CACHE = "tokenizer string, digest binary, n_tokens bigint"


def version(tokenizer: str = TOKENIZER) -> str:
    """Digest of what a count depends on: the library, its version and the vocabulary file."""
    library = "sentencepiece" if tokenizer.endswith(".model") else "tokenizers"
    head = f"{library} {importlib.metadata.version(library)} ".encode()
    return hashlib.sha256(head + Path(public_tokenizers.path(tokenizer)).read_bytes()).hexdigest()


def parts(text: str, block: int = BLOCK) -> Iterator[str]:
    """The text in parts of about ``block`` characters, cut only before a space between two small letters: a byte-level
    tokenizer starts a new piece there in any case, so the counts of the parts add up."""
    start = 0
    while len(text) - start > block:
        cut = _CUT.search(text, start + block)
        if not cut:
            break
        yield text[start : cut.start() + 1]
        start = cut.start() + 1
    yield text[start:] if start else text


_CUT = re.compile(r"[a-z] (?=[a-z])")


def counter(tokenizer: str = TOKENIZER) -> tuple[Callable[[list[str]], list[int]], bool]:
    """(function from texts to their token counts, whether texts may be encoded in ``parts``)."""
    path = public_tokenizers.path(tokenizer)
    if tokenizer.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)], False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    made_of = json.loads(Path(path).read_text())
    cut = made_of["pre_tokenizer"] or {}
    byte_level = not made_of["normalizer"] and cut.get("type") == "ByteLevel" and cut.get("use_regex")
    plain = all(" " not in t["content"] and not t["lstrip"] and not t["rstrip"] for t in made_of["added_tokens"])
    return lambda texts: [len(e) for e in made.encode_batch_fast(texts, add_special_tokens=False)], bool(byte_level and plain)


_GAP, _WORD = re.compile(r"\s\s|\0"), re.compile(r"(?<=\S)(?= \S)")
#: A task forgets its pieces beyond this many characters.
PIECE_CHARS = 1 << 22


def pieces(text: str) -> list[str]:
    """The text cut before every space between two characters that are not white space; each piece but the first begins
    with that space. A byte-level tokenizer cuts there in any case."""
    return _WORD.split(text) if _GAP.search(text) else text.replace(" ", "\0 ").split("\0")


def _counts(texts: Iterator[str], tokenizer: str, block: int) -> Iterator[int]:
    """Token counts of texts, in order. Where pieces can be told apart, a task encodes each piece it meets once."""
    count, divisible = counter(tokenizer)
    known: dict[str, int] = {}
    size = 0
    for text in texts:
        if not divisible:
            yield count([text])[0]
            continue
        total = 0
        for part in parts(text, block):
            cut = pieces(part)
            new = list(set(cut).difference(known))
            known.update(zip(new, count(new)))
            size += sum(map(len, new))
            total += sum(map(known.__getitem__, cut))
            if size > PIECE_CHARS:
                known, size = {}, 0
        yield total


def digest(text):
    """Digest of the normalised content: a null text is the empty one. No other two texts may share a count, as a
    tokenizer may tell apart any characters, so nothing else is normalised away."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def stored(spark: SparkSession, cache: str, key: str) -> DataFrame:
    """(digest, n_tokens) that a cache holds for the tokenizer version ``key``, one row per digest; nothing if the cache
    does not exist. Appends that ran twice do not matter."""
    try:
        found = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], CACHE)
    return found.where(F.col("tokenizer") == key).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encoded(texts: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """(digest, n_tokens) of a table of (digest, text)."""

    def run(batches):
        for batch in batches:
            counted = list(_counts((t.as_py() for t in batch.column(1)), tokenizer, block))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), pa.array(counted, pa.int64())], ["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens bigint")


def token_counts(
    df: DataFrame,
    cache: str | None = None,
    tokenizer: str = TOKENIZER,
    limit: int = LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = 200_000,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (more tokens than ``limit``).

    ``cache`` is a folder in a store that all executors reach; it is made if absent and appended to. Without one, a
    fresh cache in the shared folder is used, so copies are still encoded once. A null text is the empty one (0 bytes,
    0 tokens). Repeated rows and null ids are rows like any other. Special strings in a text are what the library takes
    them for by default. An empty table gives no rows. Only id and text are read, so other columns cannot clash.

    A text is sent through a shuffle only if the cache lacks it and, but for a few copies that tasks have in common,
    once; if the misses are measured few, other texts do not leave their task at all.
    """
    spark = df.sparkSession
    cache = cache or fresh_path(spark, "token-counts")
    key = version(tokenizer)
    docs = documents_of(df, id_col, text_col)
    rows = docs.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), digest(F.col("text")).alias("digest"))
    keyed = materialize(rows, "digests")
    known = stored(spark, cache, key)
    misses = keyed.select("digest").distinct()
    texts = docs.select(digest(F.col("text")).alias("digest"), "text")
    if known.isEmpty():
        needed = texts.dropDuplicates(["digest"])
    else:
        misses = materialize(misses.join(known, "digest", "left_anti"), "misses")
        if fits(misses, max_rows):
            needed = texts.join(F.broadcast(misses), "digest", "left_semi").dropDuplicates(["digest"])
        else:
            needed = texts.dropDuplicates(["digest"]).join(misses, "digest", "left_semi")
    added = encoded(needed, tokenizer).withColumn("tokenizer", F.lit(key))
    added.write.mode("append").partitionBy("tokenizer").parquet(cache)
    return keyed.join(stored(spark, cache, key), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
