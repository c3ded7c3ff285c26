"""From documents to packed training sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from churnspark.llm import queries
from churnspark.session import materialize, prepare


def _stage(work):
    """A stage prepares its session itself, as each may be called alone."""
    return lambda spark, docs, sf_dir: work(prepare(spark), docs, sf_dir)


#: (name, function of (spark, docs, sf_dir)), in order.
STAGES = [
    ("quality_classifier", _stage(queries.keep_good)),
    ("simhash_near_dedup", _stage(queries.keep_one_of_near_copies)),
    ("suffix_array_dedup", _stage(queries.cut_repeats)),
    ("benchmark_decontamination", _stage(queries.drop_contaminated)),
    ("best_fit_packing", _stage(queries.pack_sequences)),
]

#: No SQL: a fitted classifier, SimHash, byte ranges and token ids are not expressible in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``; the rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
