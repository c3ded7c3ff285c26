"""Stored collections, rejected rows, sketches, itemsets, names, passages and handed-over streams."""

import gzip
import random
from collections import Counter
from datetime import datetime, timedelta
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from churnspark.operators import evaluation as E, profile as P, questions as Q, retrieval as R
from churnspark.session import local_path
from churnspark.sources import readers, sinks
from churnspark.streaming import events as S
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F


def test_only_touched_buckets_are_rewritten(spark):
    points = spark.createDataFrame([(i, f"old{i}", 1) for i in range(400)], "id bigint, v string, version bigint")
    path = sinks.store_points(points, "id", buckets=16)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("part-*.parquet")}
    before = files()
    changes = spark.createDataFrame([(5, "new5", 2), (900, "new900", 1), (6, "older6", 0)], "id bigint, v string, version bigint")
    touched = sinks.upsert_stored(path, changes, "id", "version", buckets=16)
    after = files()
    folder = lambda f: int(f.split("bucket=")[1].split("/")[0])
    assert 1 <= len(touched) <= 3
    assert {f for f in before if folder(f) not in touched} == {f for f in after if folder(f) not in touched}
    assert all(before[f] == after[f] for f in before if folder(f) not in touched)
    assert not {f for f in before if folder(f) in touched} & set(after)
    want = {i: f"old{i}" for i in range(400)} | {5: "new5", 900: "new900"}
    assert {r.id: r.v for r in sinks.read_points(spark, path).collect()} == want
    assert sinks.upsert_stored(path, changes.where("false"), "id", "version", buckets=16) == [] and files() == after


def test_rejected_rows(spark, tmp_path):
    good = 'T1,"Acme, Inc",SMB,a,b,High,2024-01-01 00:00:00,2024-01-02 00:00:00,5,"two\nlines",notes,4'
    lines = [good, "T2,Acme", good + ",one,more", good.replace(",5,", ",soon,"), good.replace("2024-01-01 00:00:00", "yesterday"), good.replace("T1", "T9")]
    (tmp_path / "tickets.csv").write_text("\n".join(lines) + "\n")
    kept, bad = readers.read_csv_checked(spark, str(tmp_path), readers.TICKETS, header=False)
    assert [(r.ticket_id, r.description) for r in kept.orderBy("ticket_id").collect()] == [("T1", "two\nlines"), ("T9", "two\nlines")]
    path = sinks.append_rejects(bad)
    sinks.append_rejects(bad.limit(0), path)
    found = spark.read.parquet(path).collect()
    assert sorted(r.reason for r in found) == ["created_date is not timestamp", "resolution_hours is not int", "too few fields", "too many fields"]
    assert all(r.file.endswith("tickets.csv") and r.record for r in found)


def test_merged_sketches_are_within_their_bound(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(3, 2, 20_000), np.full(10_000, 7.0)])
    rows = [(int(i % 40), float(v)) for i, v in enumerate(values)] + [(1, None)]
    sketches = P.quantile_sketches(spark.createDataFrame(rows, "day int, v double").repartition(5), "v", ["day"])
    assert sketches.count() == 40
    found = P.merged_quantiles(sketches, {"a": 0.1, "b": 0.5, "c": 0.9}).first()
    for label, p in (("a", 0.1), ("b", 0.5), ("c", 0.9)):
        assert (values < found[label]).mean() - P.RANK_ERROR <= p <= (values <= found[label]).mean() + P.RANK_ERROR
    assert found["n"] == 30_000
    assert P.merged_quantiles(sketches.where("false"), {"a": 0.1}).count() == 0


def test_product_combinations(spark):
    rng = random.Random(3)
    used = {a: rng.sample("abcdefg", rng.randint(1, 5)) for a in range(80)} | {a: ["a", "b", "c"] for a in range(80, 120)}
    table = spark.createDataFrame([(a, p) for a, ps in used.items() for p in ps], "account_id int, product string")
    want = Counter(c for ps in used.values() for n in (2, 3) for c in combinations(sorted(ps), n))
    for least in (1, 8, 45):
        found = {tuple(r["items"]): r["accounts"] for r in P.product_combinations(table, least).collect()}
        assert found == {c: n for c, n in want.items() if n >= least}
    assert P.product_combinations(table.where("false"), 2).count() == 0


@pytest.mark.parametrize("max_names", [200_000, 5])
def test_names_in_one_or_many_automata(spark, max_names):
    rng = random.Random(4)
    names = ["".join(rng.choices("abAB é", k=rng.randint(1, 5))) for _ in range(60)] + ["", None, "he", "she", "hers"]
    texts = [(i, "".join(rng.choices("abABé  x", k=rng.randint(0, 40)))) for i in range(50)] + [(50, None), (51, ""), (52, "Ushers"), (53, "a"), (53, "b")]
    asked, known = spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame([(n,) for n in names], "name string")
    for ignore_case in (True, False):
        same = str.lower if ignore_case else str
        found = Q.mentions(asked, known, "k", "t", ignore_case=ignore_case, max_names=max_names)
        want = Counter((k, n) for k, t in texts if t for n in {n for n in names if n} if same(n) in same(t))
        assert Counter(map(tuple, found.collect())) == want
    plan = Q.mentions(asked, known, "k", "t")._jdf.queryExecution().toString()
    assert "transform(sequence" not in plan and "Generate" not in plan


def test_shared_opening_is_no_key(spark):
    """A third of the passages and most texts share an opening of eight words; keys are the passages' rarest runs."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(5000)}"
    opening = "this text is sent to all of our customers and"
    passages = [(i, f"{opening if i % 3 == 0 else word()} {' '.join(word() for _ in range(12))}") for i in range(90)]
    docs = [(i, f"{opening} {' '.join(word() for _ in range(30))} {passages[i % 90][1]} end") for i in range(200)]
    texts = spark.createDataFrame(docs, "doc_id int, text string")
    asked = spark.createDataFrame(passages, "question_id int, text string")
    found = sorted((r.doc_id, r.question_id) for r in E.contained(texts, asked).collect())
    assert found == sorted((d, p) for d, t in docs for p, s in passages if s in t)
    inner = asked.withColumn("_words", E._words(F.col("text"))).withColumn("_inner", F.expr("slice(_words, 2, size(_words) - 2)"))
    met, rarest = E.rarest_runs(texts, inner)
    pairs = met.join(rarest, ["_size", "_gram"])
    per_key = pairs.groupBy("_gram").count().agg(F.max("count")).first()[0]
    assert pairs.count() <= 1.1 * len(found) and per_key <= 0.05 * pairs.count()


def test_runs_of_words_are_hashed_once(spark, monkeypatch):
    """A text's runs are made without a row or an expression per run; few or many passages give the same pairs."""
    rng = random.Random(8)
    docs = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([0, 3, 60])))) for i in range(150)] + [(900, None), (901, "ß-é x1 y2 z3. end")]
    texts = spark.createDataFrame(docs, "doc_id int, text string")
    cut = [" ".join(t.split()[a : a + n]) for (_, t), a, n in zip(docs[:150], range(150), [1, 2, 3, 5, 8, 12] * 25) if t and len(t.split()) > a + n]
    asked = [*enumerate([*cut, "", "-é x1 y2 z", "nowhere to be found in it", "1 y"]), (5000, None)]
    passages = spark.createDataFrame(asked, "question_id int, text string")
    pairs = lambda: sorted((r.doc_id, r.question_id) for r in E.contained(texts, passages).collect())
    want = sorted((d, q) for d, t in docs if t for q, s in asked if s and s in t)
    runs = E.passage_runs(passages)
    plan = E._gram_rows(texts, "doc_id", [2, 6], runs.select("_size", "_gram").distinct())._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    assert pairs() == want
    monkeypatch.setattr(E, "fits", lambda df: False)
    assert pairs() == want


def test_failing_scorer_falls_back(spark):
    docs = spark.createDataFrame([(i, f"Price is high for plan {i}. Support is slow {i % 3}. We like dogs.") for i in range(30)], "doc_id bigint, text string")
    asked = spark.createDataFrame([("a", "price of plan 3"), ("b", "slow support")], "question_id string, text string")
    retriever = R.Retriever(docs)
    rows = lambda df: sorted((r.question_id, r["rank"], r.doc_id, r.text) for r in df.collect())
    compressed = rows(R.contextual_compression(retriever, asked, 3))

    def broken(scores):
        raise RuntimeError("model is gone")

    for scorer in (F.lit(None), R.guarded(broken, "score"), F.lit(float("nan"))):
        found = R.reranking(retriever, asked, 3, scorer=scorer)
        assert rows(found) == compressed and {r.method for r in found.collect()} == {"reranking"}
    partly = rows(R.reranking(retriever, asked, 3, scorer=F.when(F.col("question_id") == "a", F.col("bm25"))))
    assert partly == [r for r in rows(R.reranking(retriever, asked, 3)) if r[0] == "a"] + [r for r in compressed if r[0] == "b"]
    same = R.reranking(retriever, asked, 3, scorer=R.guarded(lambda s: s, "bm25"))
    assert rows(same) == rows(R.reranking(retriever, asked, 3))


# Streams


def events(spark, n=4000, days=100, seed=9):
    rng = random.Random(seed)
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(days * 1440)), rng.randrange(5), rng.choice(["error", "click", "view"]), 1.0, "{}") for i in range(n)]
    return spark.createDataFrame(rows, S.EVENT_SCHEMA)


def as_events(table):
    return table.select("event_id", F.col("user_id").alias("account_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")


def test_backlog_and_live_stream_equal_the_batch(spark):
    table = events(spark).cache()
    cut = F.lit(datetime(2024, 3, 1)).cast("timestamp_ntz")
    handed = S.hand_over(as_events(table.where(F.col("ts") < cut)))
    path = S.written_in_slices(table.where(F.col("ts") >= cut), 6)
    late = table.where((F.col("ts") < F.lit(datetime(2024, 2, 1)).cast("timestamp_ntz")) & (F.col("event_id") % 4 == 0))
    # Two kinds of late events: behind the backlog's watermark, and behind the stream's own.
    behind = table.where(F.col("ts").between(F.lit(datetime(2024, 3, 1)).cast("timestamp_ntz"), F.lit(datetime(2024, 3, 12)).cast("timestamp_ntz")))
    late.union(behind).coalesce(1).write.parquet(f"{path}/slice=6")
    progress = []
    live = S.read_events(spark, f"{path}/*/*.parquet", max_files=1)
    found = S.continued(handed, live, S.engagement_weekly, ["week_start", "account_id"], progress)
    want = S.engagement_weekly(as_events(table))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert sum(p["late"] for p in progress) == late.count() > 0
    assert sum(p["dropped"] for p in progress) > 0
    # Open windows only: at most three weeks of five accounts are held at any trigger, of fifteen.
    assert len([p for p in progress if p["state"]]) >= 5 and max(p["state"] for p in progress) <= 3 * 5


def test_ingest_after_a_backlog(spark):
    table = events(spark, 1500, 60).cache()
    cut = datetime(2024, 2, 10)
    older = table.where(F.col("ts") < F.lit(cut).cast("timestamp_ntz"))
    handed = S.hand_over(as_events(older))
    path = S.written_in_slices(table.where(F.col("ts") >= F.lit(cut).cast("timestamp_ntz")), 5)
    older.where(F.col("ts") >= F.lit(cut - timedelta(hours=20)).cast("timestamp_ntz")).coalesce(1).write.parquet(f"{path}/slice=00")
    progress = []
    live = S.read_events(spark, f"{path}/*/*.parquet", max_files=1)
    twice = live.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    found = S.continued_ingest(handed, twice, progress)
    assert sorted(r.event_id for r in found.collect()) == list(range(1500))
    assert max(p["state"] for p in progress) < 0.6 * 1500


def test_empty_backlog_and_empty_stream(spark):
    table = events(spark, 50, 5)
    nothing = table.where("false")
    handed = S.hand_over(as_events(nothing))
    live = S.read_events(spark, f"{S.written_in_slices(table, 2)}/*/*.parquet", max_files=1)
    found = S.continued(handed, live, S.engagement_weekly, ["week_start", "account_id"])
    assert sum(r.events for r in found.collect()) == 50
    handed = S.hand_over(as_events(table))
    live = S.read_events(spark, f"{S.written_in_slices(nothing, 2)}/*/*.parquet", max_files=1)
    assert sum(r.events for r in S.continued(handed, live, S.engagement_weekly, ["week_start", "account_id"]).collect()) == 50


def test_text_folder_is_written_by_many_tasks(spark, monkeypatch):
    """Rows of one partition are dealt by number of files, and nothing is left for the driver to move."""
    monkeypatch.setattr(sinks, "TASK_FILES", 10)
    texts = spark.createDataFrame([(f"N{i:03d}", f"line {i}\nend") for i in range(60)], "name string, value string").coalesce(1)
    path = sinks.write_text_folder(texts)
    files = [f for f in Path(path).rglob("part-*") if f.suffix == ".txt"]
    assert len(files) == 60 and len({f.name.split("-")[1] for f in files}) > 3
    read = readers.read_text_folder(spark, path, "a", "b").collect()
    assert {(r.file_path.split("name=")[1].split("/")[0], r.content) for r in read} == {(f"N{i:03d}", f"line {i}\nend\n") for i in range(60)}


ODD_NAMES = ["plain", "a b", "a/b", "50%", "x=1:2", "été", "[q]{w}^", "back\\slash", "tab\there", "", None]


def test_local_text_folder_is_what_sparks_writer_makes(spark, tmp_path):
    """Same folders and bytes, odd names and repeated ones too, but nothing that starts a process per file."""
    rows = [(name, f"text {i}\nend") for i, name in enumerate(ODD_NAMES)] + [("nothing", None), ("twice", "same"), ("twice", "same")]
    texts = spark.createDataFrame(rows, "name string, value string")
    texts.coalesce(1).write.partitionBy("name").text(f"{tmp_path}/spark")
    sinks.write_text_folder(texts, f"file://{tmp_path}/own")
    found = [
        {f.parent.name: sorted(f.read_bytes().split(b"\n")) for f in (tmp_path / by).rglob("part-*.txt")} | {"done": (tmp_path / by / "_SUCCESS").exists()}
        for by in ("spark", "own")
    ]
    assert found[0] == found[1] and len(found[1]) == len(ODD_NAMES) - 1 + 2 + 1  # no name and an empty one are one
    assert not [f for f in (tmp_path / "own").rglob(".*")]
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        sinks.write_text_folder(texts, f"file://{tmp_path}/own")


def test_text_folder_in_another_store(spark, tmp_path):
    """A store that Python cannot open is left to Spark's writer."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.texts.link./at", f"file://{tmp_path}")
    texts = spark.createDataFrame([(f"N{i}", f"text {i}") for i in range(20)], "name string, value string")
    path = sinks.write_text_folder(texts, "viewfs://texts/at/folder")
    assert local_path(spark, path) is None and local_path(spark, f"file://{tmp_path}/folder") == f"{tmp_path}/folder"
    read = readers.read_text_folder(spark, path, "a", "b").collect()
    assert {(r.file_path.split("name=")[1].split("/")[0], r.content) for r in read} == {(f"N{i}", f"text {i}\n") for i in range(20)}


def test_text_file_of_a_task_that_runs_twice(spark, tmp_path):
    """Attempts of a task name a file alike, so one that is run again adds none."""
    rows = spark.createDataFrame([(f"N{i:02d}", f"text {i}") for i in range(20)], "name string, value string").coalesce(1)
    binary = rows.select(*[F.col(c).cast("binary").alias(c) for c in rows.columns])
    writer = sinks._file_writer(str(tmp_path).encode(), "run")
    for _ in range(2):
        assert binary.mapInArrow(writer, "files bigint").collect()[0].files == 20
    assert sorted(f.name for f in tmp_path.rglob("*") if f.is_file()) == ["part-00000-run.txt"] * 20


FILES = ["plain.txt", "a b/f.txt", "50%25/f.txt", "x=1:2/f.txt", "été/f.txt", "nb x/f.txt", "c\u0085d/日.txt", "q`|<>~'()!,;$&+@\"#/f.txt"]
FILES += ["deep/er/still/f.txt", "_key=1/f.txt", "_skip/f.txt", ".skip/f.txt", "_SUCCESS", ".hidden", "f._COPYING_", "empty/f.txt"]


def test_local_text_folder_is_what_sparks_reader_reads(spark, tmp_path, monkeypatch):
    """Same paths, names and bytes, hidden and empty files left out, though no list of files reaches the driver."""
    for i, name in enumerate(FILES):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name.startswith("empty") else b"text %d\r\nend\xff\xfe" % i)
    (tmp_path / "link").symlink_to(tmp_path / "deep")
    monkeypatch.setattr(readers, "TASK_FILES", 3)
    monkeypatch.setattr(readers, "BATCH_ROWS", 2)

    def rows(path):
        read = readers.read_text_folder(spark, path, "a", "b").withColumn("content", F.col("content").cast("binary"))
        return sorted(read.collect()), read

    path = f"file://{tmp_path}"
    own, read = rows(path)
    assert len(own) == 11 and not [f for f in read.inputFiles() if f.endswith(".txt")]
    assert rows(str(tmp_path))[0] == own
    monkeypatch.setattr(readers, "_local_files", lambda *_: None)
    assert rows(path)[0] == own and rows(str(tmp_path))[0] == own


def test_text_folder_that_spark_has_to_read(spark, tmp_path):
    """Packed files, files with checksums, patterns and single files are read by Spark; a missing path is reported by it."""
    for folder in ("packed", "checked", "few"):
        (tmp_path / folder / "in").mkdir(parents=True)
        (tmp_path / folder / "in" / "f.txt").write_text("plain")
    (tmp_path / "packed" / "in" / "g.txt.gz").write_bytes(gzip.compress(b"packed"))
    spark.createDataFrame([("checked",)], "value string").coalesce(1).write.text(f"{tmp_path}/checked/in/spark")
    read = lambda at: sorted(r.content for r in readers.read_text_folder(spark, f"{tmp_path}/{at}", "a", "b").collect())
    assert read("packed") == ["packed", "plain"] and read("checked") == ["checked\n", "plain"]
    assert read("f*") == read("few/in/f.txt") == read("few") == ["plain"]
    damaged = next((tmp_path / "checked" / "in" / "spark").glob("part-*"))
    damaged.write_text("changed\n")
    with pytest.raises(Exception, match="(?i)checksum"):
        read("checked")
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read("nowhere")
    (tmp_path / "nothing").mkdir()
    assert read("nothing") == []
