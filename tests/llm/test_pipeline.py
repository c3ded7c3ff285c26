"""The registered queries, the pipeline and its stages."""

import hashlib
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry
import corpus_pipeline
from check import compare, duck
from churnspark.llm import best_fit, queries
from test_pairs import brute_components, brute_hits, brute_near, brute_repeats, brute_simhash

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [*queries.QUERIES, "pipeline"])
def test_query_is_registered_and_whole(spark, name):
    df = entry.queries()[name](spark, SF)
    if name in entry.oracle_sql():
        assert compare(df, duck(SF), entry.oracle_sql()[name]) is None
    else:
        source = spark.read.parquet(f"{SF}/{'pages' if name.startswith('op3') else 'documents'}.parquet")
        key = source.columns[0]
        found = {r[0] for r in df.select(key).collect()}
        everything = {r[0] for r in source.select(key).collect()}
        assert found <= everything if name == "pipeline" else found == everything


def test_op2_op6_op8_on_whole_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = {r["doc_id"]: r for r in queries.op2_simhash(spark, SF).collect()}
    prints = [brute_simhash(t) for _, t in docs]
    assert [found[i]["component_id"] for i, _ in docs] == [docs[c][0] for c in brute_components(prints, 3)]
    found = {r["doc_id"]: r for r in queries.op6_bwt_repeats(spark, SF).collect()}
    data, gone = brute_repeats([t for _, t in docs], 400)
    for (i, _), d, g in zip(docs, data, gone):
        rest = bytes(b for b, x in zip(d, g) if not x)
        assert (found[i]["n_removed"], found[i]["kept_sha256"]) == (int(g.sum()), hashlib.sha256(rest).hexdigest())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {r["doc_id"]: r for r in queries.op8_winnowing(spark, SF).collect()}
    for i, t in docs:
        n, hit, names = brute_hits(t, [(str(a), b) for a, b in items])
        assert (found[i]["n_words"], found[i]["n_hit"], found[i]["n_items"]) == (n, hit, len(names))


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes


def test_stages_on_odd_rows(spark, make):
    passage = " ".join(f"shared{i}" for i in range(60))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    plain = [" ".join(f"w{i}x{j}" for j in range(120)) for i in range(6)]
    pairs = [(0, plain[0]), (1, plain[0]), (2, plain[1] + " " + passage), (3, passage + " " + plain[2]), (4, plain[3] + " " + item + " end"), (5, plain[4]), (5, plain[4]), (None, plain[5]), (7, None), (8, "")]
    docs = make(pairs).withColumnRenamed("n", "accepted").withColumnRenamed("bits", "component_id")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["simhash_near_dedup"](spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [0, 2, 3, 4, 5, 7]
    cut = {r["doc_id"]: r for r in stages["suffix_array_dedup"](spark, docs, SF).collect()}
    assert cut[2]["text"].startswith(plain[1]) and "shared30" not in cut[2]["text"] + cut[3]["text"] and cut[2]["n_chars"] == len(cut[2]["text"])
    assert cut[4]["text"] == pairs[4][1] and cut[None]["text"] == plain[5] and cut[0]["text"] == "" and cut[7]["text"] == ""
    clean = [r["doc_id"] for r in stages["benchmark_decontamination"](spark, docs, SF).collect()]
    assert 4 not in clean and len(clean) == len(pairs) - 1
    assert stages["quality_classifier"](spark, docs, SF).count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_pipeline_equals_its_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    graded = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in graded)
    first = brute_near([t for _, t in rows])
    rows = [x for i, x in enumerate(rows) if first[i] == i]
    data, gone = brute_repeats([t for _, t in rows], queries.PASSAGE_BYTES)
    rows = [(i, bytes(b for b, x in zip(d, g) if not x).decode(errors="ignore")) for (i, _), d, g in zip(rows, data, gone)]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not brute_hits(t, items)[1]]
    want = {}
    for i, t in rows:
        ids = [*best_fit.encoder()(t), 0]
        want[i] = (len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[: len(ids) % 2048 or 2048])))
    found = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        length, crc = found.get(r["doc_id"], (0, None))
        found[r["doc_id"]] = (length + r["length"], r["ids_crc32"] if r["piece"] == 0 else crc)
    assert found == want
