"""Searches that skip what cannot be among the best, against searches that look at everything."""

import random
import shutil

import numpy as np
import pytest
from churnspark.operators import dense, impact, index as I, latent, retrieval as R, sparse, vector_groups
from churnspark.session import kept, materialize, release
from pyspark.sql import functions as F


def corpus(n, seed=1):
    """Common and rare words; a third of all texts are copies of one."""
    rng = random.Random(seed)
    common, rare = [f"common{i}" for i in range(12)], [f"rare{i}" for i in range(400)]
    made = [" ".join(rng.choices(common, k=rng.randint(1, 60)) + rng.choices(rare, k=rng.randint(0, 4))) for _ in range(n)]
    return [(i, made[0] if i % 3 == 0 else t) for i, t in enumerate(made)]


def rounded(rows, keys):
    return sorted((*[r[k] if r[k] is not None else -1 for k in keys], r["kind"], round(r["score"], 9), round(r["bm25"], 6), r["rank"]) for r in rows)


QUESTIONS = [("a", "rare1 rare2 common1"), ("b", "common1 common2 common3"), ("c", "rare7"), ("d", "unknown words"), ("e", None), ("f", ""), ("g", "rare3 rare3 common5 rare9 x")]


@pytest.mark.parametrize("block", [1024, 4])
def test_threshold_search_equals_full_scoring(spark, block):
    docs = spark.createDataFrame(corpus(900), "doc_id bigint, text string")
    index = I.build(docs, ["doc_id"])
    asked = spark.createDataFrame(QUESTIONS, "question_id string, text string")
    blocks, report = impact.order(index, block), []
    found = impact.best(blocks, asked, ["question_id"], 5, report=report).collect()
    assert rounded(found, ["question_id", "doc_id"]) == rounded(I.best(index, asked, ["question_id"], 5).collect(), ["question_id", "doc_id"])
    share = impact.skipped(blocks, report[0]).first()
    assert 0 < share["n_read"] < 0.8 * share["n"] and share["parts_read"] < share["parts"]
    largest = max(len(r["entries"]) for r in blocks.blocks.select("entries").collect())
    assert largest <= 4 * block
    dense_instead = impact.best(blocks, asked, ["question_id"], 5, worth=0.0).collect()
    assert rounded(dense_instead, ["question_id", "doc_id"]) == rounded(found, ["question_id", "doc_id"])


def test_threshold_search_writes_no_row_per_question_and_text(spark, monkeypatch):
    """Sums are written by text, and only the best few are scored from the postings."""
    index = I.build(spark.createDataFrame(corpus(900), "doc_id bigint, text string"), ["doc_id"])
    asked = spark.createDataFrame(QUESTIONS, "question_id string, text string")
    blocks, written = impact.order(index), {}

    def counting(df, label):
        out = materialize(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(impact, "materialize", counting)
    found = impact.best(blocks, asked, ["question_id"], 5).collect()
    assert rounded(found, ["question_id", "doc_id"]) == rounded(I.best(index, asked, ["question_id"], 5).collect(), ["question_id", "doc_id"])
    assert written["sums"] <= 900 and written["left"] <= 5 * len(QUESTIONS)


def test_threshold_search_within_allowed_texts(spark):
    docs = spark.createDataFrame(corpus(300), "doc_id bigint, text string")
    index = I.build(docs, ["doc_id"])
    asked = spark.createDataFrame(QUESTIONS, "question_id string, text string")
    allowed = spark.createDataFrame([(i,) for i in range(0, 300, 7)], "doc_id bigint")
    found = impact.best(impact.order(index), asked, ["question_id"], 5, allowed=allowed).collect()
    from dataclasses import replace

    own = replace(index, postings=index.postings.join(allowed, "doc_id", "left_semi"))
    assert rounded(found, ["question_id", "doc_id"]) == rounded(I.best(own, asked, ["question_id"], 5).collect(), ["question_id", "doc_id"])


def test_threshold_search_of_chunks_and_parents(spark):
    long = [(i, ". ".join(t for _, t in corpus(12, i))) for i in range(25)]
    retriever = R.Retriever(spark.createDataFrame(long, "doc_id bigint, text string"))
    asked = spark.createDataFrame([(q, 0, t) for q, t in QUESTIONS] + [("a", 1, "rare4 common2")], "question_id string, variant int, text string")
    ids, keys = ["question_id", "variant"], ["question_id", "variant", *R.CHILD_KEYS]
    found = impact.best(impact.order(retriever.index), asked, ids, 4, True).collect()
    assert rounded(found, keys) == rounded(I.best(retriever.index, asked, ids, 4, True).collect(), keys)


def test_questions_that_share_frequent_terms_are_searched_once(spark, monkeypatch):
    """The rows of the full search, with ties among copies, repeated words, questions without rare or frequent terms."""
    monkeypatch.setattr(I, "RARE", 30)
    index = I.build(spark.createDataFrame(corpus(600), "doc_id bigint, text string"), ["doc_id"])
    made = [(f"q{i}", f"why did rare{i % 400} go to common1 and common{i % 2}" + " rare5" * (i % 3)) for i in range(500)]
    asked = spark.createDataFrame(made + QUESTIONS, "question_id string, text string")
    read = []
    dense = I._best_dense
    monkeypatch.setattr(I, "_best_dense", lambda index, terms, *rest: read.append(terms.select(terms.columns[0]).distinct().count()) or dense(index, terms, *rest))
    want = rounded(I.best(index, asked, ["question_id"], 5).collect(), ["question_id", "doc_id"])
    got = rounded(I.best(index, asked, ["question_id"], 5, many=0).collect(), ["question_id", "doc_id"])
    assert got == want and len(read) == 2 and read[1] < read[0] / 2
    plain = spark.createDataFrame(QUESTIONS, "question_id string, text string")  # these share too little
    same = rounded(I.best(index, plain, ["question_id"], 5, many=0).collect(), ["question_id", "doc_id"])
    assert same == rounded(I.best(index, plain, ["question_id"], 5).collect(), ["question_id", "doc_id"])


def test_postings_are_weighed_where_they_are(spark, monkeypatch):
    """No posting is shuffled, and frequencies in many parts, held one at a time, give the same weights."""
    texts = corpus(120) + [(900, ""), (901, None), (902, "alone")]
    docs = spark.createDataFrame([(i, ". ".join([t or ""] * 9)) for i, t in texts], "doc_id bigint, text string")
    counted = materialize(I.counted_rows(R.Retriever(docs).children(docs), R.CHILD_KEYS), "counts")
    df = materialize(counted.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "df")
    rows = lambda found: sorted(map(tuple, I._entries(found, R.CHILD_KEYS).collect()))
    whole = I._weighted(counted, R.CHILD_KEYS, df, 500, I.PART_BYTES)
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(I, "HELD_PARTS", 1)
    assert rows(I._weighted(counted, R.CHILD_KEYS, df, 500, 600)) == rows(whole)
    length = I._entries(whole, R.CHILD_KEYS).groupBy(*R.CHILD_KEYS).agg(F.sum(F.col("weight") * F.col("weight")).alias("s"))
    assert all(abs(r.s - 1) < 1e-9 for r in length.collect())


def test_postings_of_a_text_are_read_together(spark):
    """However files are cut into tasks, scores are of whole texts."""
    docs = spark.createDataFrame(corpus(200), "doc_id bigint, text string")
    asked = spark.createDataFrame(QUESTIONS, "question_id string, text string")
    want = rounded(I.best(I.build(docs, ["doc_id"]), asked, ["question_id"], 5).collect(), ["question_id", "doc_id"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        assert rounded(I.best(I.build(docs, ["doc_id"]), asked, ["question_id"], 5).collect(), ["question_id", "doc_id"]) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_search_reads_rows_without_sorting_them(spark):
    """No posting is sorted, joined or shuffled for a search, and no weight of a posting is stored; rows are those of a
    plain count, with many ties and keys that are not numbers."""
    made = [(f"d{i:04}", t) for i, t in corpus(700)]
    index = I.build(spark.createDataFrame(made, "doc_id string, text string").repartition(3), ["doc_id"])
    assert "weight" not in index.stored.columns
    asked = spark.createDataFrame(QUESTIONS, "question_id string, text string")
    terms = I.question_terms(index, asked, ["question_id"]).collect()
    found = sparse.search(index.rows(), (index.n, index.mean_length), terms, ["question_id"], [asked.schema["question_id"]], ["doc_id"], 5, False)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Sort", "Join", "Exchange", "Generate"))
    weights = {}
    for r in index.postings.collect():
        weights.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    want = []
    for q in {r["question_id"] for r in terms}:
        own = {r["term"]: r["q_weight"] for r in terms if r["question_id"] == q}
        scored = sorted((-round(sum(w * held.get(t, 0.0) for t, w in own.items()), 9), d) for d, held in weights.items())
        want += [(q, d, rank, -s) for rank, (s, d) in enumerate(scored[:5], 1) if s < 0]
    got = [(r["question_id"], r["doc_id"], r["rank"], round(r["score"], 9)) for r in I.best(index, asked, ["question_id"], 5).collect()]
    assert [g[:3] for g in sorted(got)] == [w[:3] for w in sorted(want)]
    assert np.allclose([g[3] for g in sorted(got)], [w[3] for w in sorted(want)], atol=2e-9)


# Vectors


def clustered(n, seed=2, dimensions=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dimensions))
    points = centres[rng.integers(0, 12, n)] + 0.08 * rng.normal(size=(n, dimensions))
    points[::5] = points[0]  # copies of one vector
    return [(i, p.tolist()) for i, p in enumerate(points)] + [(n, None), (n + 1, [0.0] * dimensions)]


@pytest.mark.parametrize("groups,block", [(12, 16_384), (40, 30), (1, 16_384)])
def test_pruned_vector_search_equals_full_search(spark, groups, block):
    rows = clustered(1500)
    vectors = spark.createDataFrame(rows, "vec_id bigint, vec array<double>").repartition(4)
    queries = spark.createDataFrame([(f"q{i}", v) for i, v in rows[1::40]] + [("none", None)], "query_id string, vec array<double>")
    report = []
    found = vector_groups.top_k(vector_groups.group(vectors, groups, block), queries, 5, report).collect()
    want = dense.top_k(vectors, queries, 5).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(found, key=lambda r: (r["query_id"], r["rank"]))] == [
        (r["query_id"], r["rank"], r["vec_id"]) for r in sorted(want, key=lambda r: (r["query_id"], r["rank"]))
    ]
    visited, pairs = report[0]
    assert visited < 0.5 * pairs if groups == 12 else visited <= pairs


def test_pruned_vector_search_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id bigint, vec array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vec array<double>")
    assert vector_groups.top_k(vector_groups.group(none), queries).count() == 0
    one = vector_groups.group(spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 1.0])], "vec_id bigint, vec array<double>"))
    assert [r["vec_id"] for r in vector_groups.top_k(one, queries, 5).orderBy("rank").collect()] == [1, 2]
    assert vector_groups.top_k(one, queries.where("false"), 5).count() == 0


def test_latent_vectors_hold_most_of_the_weights(spark):
    """The basis holds nearly as much of the weights' squares as the best of its size; results are reproducible."""
    docs = spark.createDataFrame([*corpus(400), (900, ""), (901, None)], "doc_id bigint, text string").repartition(5)
    index = I.build(docs, ["doc_id"])
    rows = materialize(latent.sparse_rows(index.postings, ["doc_id"]), "sparse")
    by = latent.basis(rows, 8)
    assert np.allclose(by.T @ by, np.eye(8))
    full = np.zeros((902, latent.HASHED))
    for r in rows.collect():
        np.add.at(full[r["doc_id"]], r["places"], r["weights"])
    best = np.linalg.svd(full, compute_uv=False)[:8]
    assert (full @ by).ravel() @ (full @ by).ravel() >= 0.95 * (best**2).sum()
    asked = spark.createDataFrame(QUESTIONS, "question_id string, text string")
    texts, questions = latent.text_vectors(index, asked, ["question_id"], 8)
    assert {r["doc_id"] for r in texts.collect()} == set(range(400)) and {r["question_id"] for r in questions.collect()} == set("abcg")
    again = {r["doc_id"]: r["vec"] for r in latent.text_vectors(index, asked, ["question_id"], 8)[0].collect()}
    assert all(np.allclose(r["vec"], again[r["doc_id"]], atol=1e-6) for r in texts.collect())
    assert latent.basis(rows.where("false"), 8).shape == (latent.HASHED, 8)


# What a session keeps


def test_kept_values_outlive_release(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return materialize(spark.range(3), "kept")

    first = kept(spark, ("test", str(tmp_path)), make)
    other = materialize(spark.range(2), "other")
    release(spark)
    assert kept(spark, ("test", str(tmp_path)), make).count() == 3 and first.count() == 3 and made == [1]
    with pytest.raises(Exception):
        other.count()
    # Deleted by someone else, or forgotten, it is made again.
    shutil.rmtree(first.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
    assert kept(spark, ("test", str(tmp_path)), make).count() == 3 and made == [1, 1]
    release(spark, kept_too=True)
    assert kept(spark, ("test", str(tmp_path)), make).count() == 3 and made == [1, 1, 1]
